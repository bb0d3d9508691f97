"""The pipeline's stages, one after the other, over a small table with planted rows."""

import random

import pytest

import corpus_pipeline
from tablemend.llm import near_dup
from tests.llm.conftest import prose

COLUMNS = corpus_pipeline.COLUMNS
BAD = ["zounds", "blastoff", "grumblecake"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """(folder, documents): toxic ones, shared lines, copies and near copies, odd rows."""
    rng, docs, labels = random.Random(6), [], []
    for k in range(240):
        words = prose(rng, rng.randint(20, 60)).split()
        toxic = k % 4 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs.append((k, " ".join(words), "en", f"s{k % 5}"))
        if k < 200:
            labels.append((k, 1, int(toxic)))
    shared = "This line is in a great many documents of the table"
    docs += [(300 + k, prose(rng, 30) + "\n" + shared, "en", "s1") for k in range(6)]
    base = prose(rng, 80)
    docs += [(400 + k, base + (" more" if k == 3 else ""), "en", "s2") for k in range(4)]
    docs += [(500, None, None, None), (501, "", "en", "s3"), (None, "a text without an id", "en", "s3"), (502, " \n ", "en", None)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_stages_decide_as_planted(spark, planted, tmp_path):
    folder, docs = planted
    df, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, df, folder).write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = df.collect()
        if name != "packing":
            assert df.columns == COLUMNS
    ids = lambda name: sorted((r["doc_id"] for r in seen[name] if r["doc_id"] is not None))
    assert ids("toxicity") == sorted(i for i, *_ in docs if i is not None and not (i < 240 and i % 4 == 0))
    lines = {r["doc_id"]: r for r in seen["line_dedup"]}
    assert ids("line_dedup") == ids("toxicity")
    assert all(("great many" in lines[300 + k]["text"]) == (k == 5) for k in range(6))
    assert all(r["n_chars"] == len(r["text"] or "") for r in seen["line_dedup"]) and lines[500]["text"] is None
    assert [i for i in ids("near_dup") if 400 <= i < 410] == [400]
    assert [i for i in ids("near_dup") if not 400 <= i < 410] == [i for i in ids("line_dedup") if not 400 <= i < 410]
    assert set(ids("mixing")) <= set(ids("near_dup")) and all(ids("mixing").count(i) <= 2 for i in set(ids("mixing")))
    assert {r["doc_id"] for r in seen["packing"]} == {r["doc_id"] for r in seen["mixing"]}
    assert all(r["offset"] + r["length"] <= 1024 for r in seen["packing"])


def test_stages_of_empty_and_odd_tables(spark, table, odd, tmp_path):
    """No rows give no rows; nulls, blanks, copies and columns with names of the operators' own come through."""
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in ([], odd):
        df, seen = table(docs), {}
        columns = df.columns
        for name, step in corpus_pipeline.STAGES:
            after = step(spark, df, str(tmp_path))
            after.write.parquet(f"{tmp_path}/{name}-{len(docs)}")
            df = spark.read.schema(after.schema).parquet(f"{tmp_path}/{name}-{len(docs)}")
            seen[name] = df.collect()
            assert name == "packing" or df.columns == columns
        if not docs:
            assert not any(seen.values())
            continue
        assert len(seen["toxicity"]) == len(seen["line_dedup"]) == len(odd)
        # The shared line stays in 129, the shared beginning in 207; what is left of 100 … 128 is one text.
        kept = [r["doc_id"] for r in seen["near_dup"]]
        assert sorted(i for i in kept if i is not None) == [1, 2, 3, 4, 5, 7, 8, 100, 129, *range(200, 208), 300]
        assert kept.count(None) == 2
        taken = [(r["doc_id"], r["text"]) for r in seen["mixing"]]
        assert taken and max(taken.count(t) for t in set(taken)) <= 2
        assert {r["doc_id"] for r in seen["packing"]} == {i for i, _ in taken}
        assert all(r["root"] == "r" and r["size"] == "y" for name in seen if name != "packing" for r in seen[name])


def test_the_run_gives_the_last_stage(spark, planted):
    rows = corpus_pipeline.run(spark, planted[0])
    assert rows.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and rows.count() > 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dup", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_near_copies_from_four_fifths_on_go(spark):
    stage, rng, docs, stay = dict(corpus_pipeline.STAGES)["near_dup"], random.Random(9), [], set()

    def plant(length, edits, one_stays):
        """Texts of distinct words and their copies with single words, far apart, replaced."""
        words = [f"w{len(docs)}x{k}" for k in range(length)]
        copy = [f"new{k}" if k in edits else w for k, w in enumerate(words)]
        i = len(docs)
        docs.extend([(i, " ".join(words), "en", "s", 0), (i + 1, " ".join(copy), "en", "s", 0)])
        stay.update({i} if one_stays else {i, i + 1})

    for _ in range(8):
        plant(100, {rng.randint(10, 40), rng.randint(60, 90)}, True)  # 86 of 106 shingles
        plant(49, {rng.randint(10, 40)}, True)  # 40 of 50
        plant(48, {rng.randint(10, 40)}, False)  # 39 of 49
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in stage(spark, df, "").collect()} == stay


def test_bands_follow_the_threshold():
    assert {p: near_dup.band_rows(p) for p in (85, 80)} == {85: 5, 80: 4}
    for p in range(1, 100):
        rows = near_dup.band_rows(p)
        assert rows == 1 or (1 - (p / 100) ** rows) ** (near_dup.HASHES // rows) <= 1e-5
