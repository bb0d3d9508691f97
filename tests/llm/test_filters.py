"""Toxicity, personal data and URL verdicts against plain Python and held-out rows."""

import random
import re

import numpy as np
import pyarrow as pa

from tablemend.llm import pii, toxicity, url_filter, url_labels
from tablemend.llm.queries import URL_RULES
from tests.llm.conftest import prose

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def accepted(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if accepted(k, m.group()))


TRICKY = [
    None, "", "a@b.co_c@d.ef", "x@y @z.com a@b@c.de", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "a..b@c-d.e-f..g",
    "4111 1111 1111 1111 4111-1111-1111-1112 1234", "+1 (724) 555-7058, +12 3 +49 (0)30.1234.567- x +1", "日本 🙂 a.b@c.de 10.0.0.1",
    "99999999999999999999999.1.1.1 1.1.1.99999999999999999999", "5500005555555559 5500 0055 5555 5559", "+" * 50 + "1" * 30,
    "a" * 30_000 + " " + "1" * 20_000 + " " + "1." * 5_000 + "a@" + "b." * 9_000, "%+-._" * 200 + "@x.y z@" + "-." * 300,
]


def test_base_spans_of_tricky_texts(table):
    docs = [(k, t, "a") for k, t in enumerate(TRICKY)] + [(None, "me@you.org", "a"), (3, "twice@there.net", "a")]
    rows = pii.find(table(docs)).select("doc_id", pii.listed(pii.F.col("spans")).alias("s")).collect()
    assert sorted((r["doc_id"] or -1, ",".join(x for x in r["s"].split(",") if not x.startswith("term"))) for r in rows) \
        == sorted((i or -1, base(t)) for i, t, _ in docs)
    assert pii.find(table([])).collect() == []


def test_random_texts_have_the_spans_of_python(table):
    rng = random.Random(8)
    parts = ["a.b@c.de", "+1 (234) 567-8901", "1.2.3.4", "4111 1111 1111 1111", "@", ".", "-", " ", "12", "+", "x", "(", "\n", "é"]
    docs = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 40))), "a") for k in range(400)]
    rows = pii.find(table(docs)).collect()
    found = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != pii.TERM] for r in rows}
    assert found == {i: [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base(t).split(",") if x)] for i, t, _ in docs}


def test_terms_that_go_with_an_entity_are_generalised_or_removed(table):
    rng = random.Random(2)
    docs = [(k, prose(rng, 30), "a") for k in range(200)]
    docs += [(1000 + k, f"{prose(rng, 12)} our Quillon writes to q@x.org often {prose(rng, 12)}", "a") for k in range(4)]
    # Words that begin alike elsewhere: the beginning tells less than the word.
    docs += [(2000 + k, f"{prose(rng, 10)} Quilters quill {prose(rng, 10)}", "a") for k in range(30)]
    docs += [(3000 + k, f"{prose(rng, 12)} Zyxwvut writes to z@x.org often {prose(rng, 12)}", "a") for k in range(4)]
    docs += [(4000 + k, "writes often " + prose(rng, 10), "a") for k in range(40)]
    df = table(docs)
    shown = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(df).collect()}
    assert "[email]" in shown[1000] and "Quillon" not in shown[1000] and "Qui*" in shown[1000] and "writes" in shown[1000]
    assert "[email]" in shown[3000] and "Zyx" not in shown[3000] and "often" in shown[3000]
    assert all(shown[i] == t for i, t, _ in docs if i < 1000)  # clean documents stay as they are
    assert pii.sanitise(table([(1, None, "a")])).collect()[0]["sanitised"] is None


def test_a_term_tells_as_much_in_one_surrounding(table):
    rng = random.Random(3)
    docs = [(k, prose(rng, 30), "a") for k in range(200)]
    docs += [(1000, "we say that Quillon writes to q@x.org and rests", "a")]  # in one document
    docs += [(2000 + k, "we say that Zyxwvut writes to z@x.org and rests", "a") for k in range(5)]  # in exact copies
    docs += [(3000 + k, "we say that one writes to all and rests", "a") for k in range(150)]
    shown = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(table(docs)).collect()}
    assert shown[1000] == "we say that  writes to [email] and rests"
    assert all(shown[2000 + k] == "we say that  writes to [email] and rests" for k in range(5))


def test_terms_are_sought_and_marked_in_the_whole_document(table):
    rng = random.Random(4)
    far = "we say that all is well and so on " * 8
    docs = [(k, far + prose(rng, 10), "a") for k in range(200)]
    docs += [(1000, f"Quillon {far}q@x.org {far}Quillon {far}Bo {far}k9z7", "a"), (1001, "Quilt " + far, "a")]
    docs += [(1002 + k, f"quick {far}", "a") for k in range(9)] + [(1100 + k, "qui " + far, "a") for k in range(9)]
    shown = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(table(docs)).collect()}
    assert shown[1000] == f"Qui* {far}[email] {far}Qui* {far} {far}"
    assert all(shown[i] == t for i, t, _ in docs if i != 1000)


def test_words_at_the_edges_and_behind_rejected_matches_are_terms(table):
    rng = random.Random(5)
    docs = [(k, "write to our " + prose(rng, 30), "a") for k in range(200)]
    docs += [(1000, "Quillon q@x.org", "a"), (1001, "write to z@x.org Zyxwvut", "a"), (1002, "our Vlkodlak, 2024, 4111 1111 1111 1111", "a")]
    shown = {r["doc_id"]: r["sanitised"] for r in pii.sanitise(table(docs)).collect()}
    assert shown[1000] == " [email]" and shown[1001] == "write to [email] "
    assert shown[1002].startswith("our , ") and shown[1002].endswith(", [card]")


def test_spans_run_without_python(spark, table):
    plan = pii.find(table([(1, "a@b.co", "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|ExternalRDD", plan)


def labelled(n, seed):
    rng, out = random.Random(seed), []
    bad = ["zounds", "blastoff", "grumblecake", "snarlword"]
    for _ in range(n):
        toxic = rng.random() < 0.3
        words = prose(rng, rng.randint(20, 80)).split()
        for _ in range(rng.randint(2, 9) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", ",", "x", "heit"]))
        out.append((" ".join(words), int(toxic)))
    return out


def test_severity_on_held_out_rows():
    train, test = labelled(600, 1), labelled(400, 2)
    counts = toxicity.all_counts(pa.array([t for t, _ in train]))
    grades = toxicity.graded_by_amount(counts, np.array([y for _, y in train]))
    model = toxicity.fit(counts, grades, 3)
    assert (np.diff(model.cuts) > 0).all()
    above = model.above(pa.array([t for t, _ in test]))
    truth = np.array([y for _, y in test])
    assert ((above[:, 0] >= toxicity.THRESHOLD) == (truth == 1)).mean() > 0.97
    assert (above[:, 1] <= above[:, 0]).all()
    amount = np.array([sum(w.startswith(("zou", "bla", "gru", "sna")) for w in t.split()) for t, _ in test])
    expected = above.sum(axis=1)
    assert expected[amount >= 7].mean() > expected[(amount > 0) & (amount < 4)].mean() + 0.3


def test_words_counted_on_executors_give_the_same_model(spark, table):
    """As all words counted in one place; equal rows count once, other texts or labels of an id count too."""
    rows = labelled(500, 3)
    docs = [(k, t, "a") for k, (t, _) in enumerate(rows)] + [(3, rows[3][0], "a"), (4, "another text", "a"), (None, "no id", "a")]
    labels = [(k, y) for k, (_, y) in enumerate(rows)] + [(3, rows[3][1]), (None, 1), (9_999, 1)]
    model = toxicity.train(table(docs), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts = pa.array([t for t, _ in rows] + ["another text"])
    y = np.array([y for _, y in rows] + [rows[4][1]])
    counts = toxicity.all_counts(texts)
    plain = toxicity.fit(counts, toxicity.graded_by_amount(counts, y), 3)
    assert len(model.words) > 4 and (model.words == plain.words).all()
    assert np.allclose(model.above(texts), plain.above(texts), atol=1e-6)


def test_gradient_descent_finds_a_minimum():
    """The fitted likelihood is no worse than that of nearby parameters."""
    rng = np.random.default_rng(0)
    texts = pa.array([" ".join(["mark"] * k + ["word"] * 3) for k in rng.integers(0, 5, 300)])
    counts = toxicity.all_counts(texts)
    n = np.array([t.as_py().count("mark") for t in texts])
    grade = np.clip(n + rng.integers(-1, 2, 300), 0, 3) // 2 + (n > 3)
    model = toxicity.fit(counts, grade, 3, steps=1500, ridge=0)

    def loss(weights, cuts):
        p = toxicity.Severity(model.words, weights, cuts).above(texts)
        own = np.concatenate([np.ones((300, 1)), p], 1) - np.concatenate([p, np.zeros((300, 1))], 1)
        return -np.log(np.maximum(1e-12, own[np.arange(300), grade])).mean()

    least = loss(model.weights, model.cuts)
    for step in (0.2, -0.2):
        assert least <= loss(model.weights + step, model.cuts) + 1e-4
        assert least <= loss(model.weights, model.cuts + step) + 1e-4


def test_severity_of_odd_documents(spark, table, odd):
    df = table(odd)
    for labels in ([], [(1, 0), (4, 0)], [(5, 1), (None, 1), (5, None), (9999, 0)], [(4, 1), (5, 0), (4, 1)]):
        model = toxicity.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        rows = toxicity.judge(df, model).collect()
        assert len(rows) == len(odd) and all(0 <= r["__severity"] <= 2 for r in rows)
    assert toxicity.judge(table([]), model).collect() == []


URLS = [None, "", "no scheme", "http://", "https://WWW.Example.com/en/x", "http://example.com/en", "http://example.com/en/?q#f",
        "http://a.net/es/", "http://net/fr/x", "http://xnet/fr/", "ftp://b.org/fr/", "http://com", "http://x.com?a=/y", "x://y.com/a://b.net/es/",
        "http://sub.www.example.com/en/1", "http://example.com.net/es/..", "http://é.net/fr/é", "http://user@h.net:80/es/"]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max((r.name for r in fits), key=len) if fits else None


def test_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(3, "http://")], "page_id long, url string")
    model = url_filter.UrlModel(np.zeros(url_filter.CELLS), -5.0)
    rows = url_filter.judge(pages, URL_RULES, model).collect()
    got = sorted((r["page_id"], r["__host"], r["__path"], r["__rule"] or "") for r in rows)
    assert got == sorted((k, *plain_verdict(u)[:2], plain_verdict(u)[2] or "") for k, u in [*enumerate(URLS), (3, "http://")])
    verdicts = {r.name: r.verdict for r in URL_RULES}
    assert all(r["__verdict"] == verdicts.get(r["__rule"], "allow") for r in rows)


def test_urls_on_held_out_rows(spark):
    rng = random.Random(4)

    def one():
        blocked = rng.random() < 0.4
        host = rng.choice(["casino", "bets", "winbig"] if blocked else ["news", "docs", "library"]) + str(rng.randrange(99))
        return f"https://{prose(rng, 1)}.{host}.org/{prose(rng, 1)}", blocked

    train, test = [one() for _ in range(400)], [one() for _ in range(300)]
    model = url_filter.train(spark.createDataFrame(train, "url string, blocked boolean"), max_rows=300)
    score = model.scores(pa.array([u.split("://")[1] for u, _ in test]))
    assert ((score >= 0.5) == np.array([b for _, b in test])).mean() > 0.97


def test_labelled_urls_teach_names_in_unseen_forms():
    """Each form is held out once; what is new there is the form, not the stem."""
    rows, forms = url_labels.rows(), len(url_labels.FORMS)
    bare = pa.array([re.split("[?#]", u.split("://")[1])[0] for u, _ in rows])
    blocked, form = np.array([b for _, b in rows], float), np.arange(len(rows)) % forms
    score = np.zeros(len(rows))
    for k in range(forms):
        model = url_filter.fit(bare.filter(pa.array(form != k)), blocked[form != k])
        score[form == k] = model.scores(bare.filter(pa.array(form == k)))
    assert (score[blocked > 0] >= 0.5).mean() > 0.85 and (score[blocked == 0] >= 0.5).mean() < 0.02
    by_domain = {}
    for url, b in rows:
        by_domain.setdefault(url.split("/")[2].removeprefix("www.").removeprefix("m.").removeprefix("blog.").split(".", 1)[1], set()).add(b)
    assert all(kinds == {True, False} for kinds in by_domain.values())


def test_unseen_urls_get_both_verdicts(spark):
    """No rule judges these, no labelled URL has their host; columns with names of the judgement's own inputs stay."""
    wanted = {"https://www.lucky-casino24.example.org/en/7": "block", "http://online-poker-room.org/de/2.html": "block",
              "https://adtracker7.example.org/es/1": "block", "https://ththernion.example.org/en/7": "allow",
              "http://blog.county-library.org/de/2.html": "allow", "https://museum-shop.example.org/es/1": "allow", "": "allow"}
    known = {u.split("/")[2] for u, _ in url_labels.rows()}
    assert not known & {u.split("/")[2] for u in wanted if u}
    pages = spark.createDataFrame([(u, "x", "y", 1.0) for u in wanted] * 2, "url string, host string, verdict string, score double")
    got = url_filter.judge(pages, URL_RULES, url_filter.train(url_labels.labelled(spark))).collect()
    assert len(got) == 2 * len(wanted) and all(r["__rule"] is None and r["host"] == "x" for r in got)
    assert {r["url"]: r["__verdict"] for r in got} == wanted


def test_models_without_labels_or_with_one_kind(spark):
    schema = "url string, blocked boolean"
    none = url_filter.train(spark.createDataFrame([], schema))
    assert none.scores(pa.array(["a", ""])).max() < 0.01
    kind = url_filter.train(spark.createDataFrame([("http://a.b/c", True), (None, True), ("x", None)], schema))
    assert kind.scores(pa.array(["a", ""])).min() > 0.99
