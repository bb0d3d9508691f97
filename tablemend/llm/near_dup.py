"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

Documents are linked if 100 * |A and B| >= ``percent`` * |A or B| for their sets of distinct
five-word shingles (words as in the whole text, A-Z lower-cased; fewer words are one shingle).

1. Each document gets its set's size, a 128-bit digest and ``HASHES`` minhashes.  Documents
   with the same set are one vertex from here on, however many they are.
2. Vertices that agree in a band of hashes share a bucket; the bands follow from ``percent``
   (20 of 5 hashes at 85, 25 of 4 at 80).  A bucket compares signatures in
   batches: with a uniform prior, m agreements in n hashes give the similarity a
   Beta(m + 1, n - m + 1) posterior, and a pair goes as soon as the posterior chance of reaching the
   threshold falls below ``MISS``.  Survivors are not listed pair by pair: each bucket gives the
   edges of a forest over them.  A bucket of more than ``BUCKET`` vertices gives a star, a
   superset.  The components of these edges are families: every link lies inside one.
3. Families are verified exactly, on full sets fetched once per vertex.  A task compares the
   vertices of one block of a family, skipping pairs that earlier links of the task connect
   already.  A family of more than ``BLOCK`` vertices has several blocks; the blocks'
   representatives are compared next, level by level, and in the end every vertex
   outside the family's largest component meets every block, so no pair stays open.
4. The components of the confirmed links are the classes; a block names its own, so only links
   between blocks need a search for components.

What can be lost are links whose pair shares no band or falls to the posterior bound: below
1 in 10,000 at the threshold itself, far less above.

Nulls and edge cases: documents without words (null, empty, blank) are linked with nothing
and are their own class; null ids link like others but never name a class unless all ids of the class are
null; repeated rows share a class; an empty table gives no rows.  Columns besides ``doc_id``
and ``text`` may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.llm.common import stage
from tablemend.llm.components import Forest, components
from tablemend.llm.textvec import chunks, mix, shingles, words

HASHES = 100
#: Posterior chance below which a pair goes, and most of the pairs at the threshold that may share no band.
MISS, UNSEEN = 1e-6, 1e-5
BUCKET, BLOCK = 2_000, 1_024
_BATCH = 20

_random = np.random.Generator(np.random.PCG64(7))
_FACTOR = _random.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _random.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, row, hash) of chunks of texts."""
    for lo, hi, data, offs in chunks(texts):
        row, word = words(data, offs)
        yield hi - lo, *shingles(row, word, hi - lo)


def signatures(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes, first and second half of the digests, minhashes) of texts."""
    sizes, d1, d2, sigs = [], [], [], []
    for n, row, h in shingle_sets(texts):
        count = np.bincount(row, minlength=n)
        sizes.append(count)
        a, b, sig = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros((n, HASHES), np.uint32)
        has = np.flatnonzero(count)
        if len(has):
            at = np.searchsorted(row, has)
            a[has] = np.add.reduceat(mix(h ^ np.uint64(0x51)), at)
            b[has] = np.add.reduceat(mix(h ^ np.uint64(0xA7)), at)
            for k in range(HASHES):
                x = (h * _FACTOR[k] + _SHIFT[k]) >> np.uint64(32)
                sig[has, k] = np.minimum.reduceat(x, at)
        d1.append(a)
        d2.append(b)
        sigs.append(sig)
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, HASHES), np.uint32)
    return np.concatenate(sizes), np.concatenate(d1), np.concatenate(d2), np.concatenate(sigs)


def fewest_agreements(threshold: float, miss: float = MISS) -> np.ndarray:
    """Per batch, the least number of agreements with which a pair may stay."""
    s = (np.arange(20_000) + 0.5) / 20_000
    least = []
    for n in range(_BATCH, HASHES + 1, _BATCH):
        m = np.arange(n + 1)[:, None]
        density = m * np.log(s)[None, :] + (n - m) * np.log1p(-s)[None, :]
        density = np.exp(density - density.max(axis=1, keepdims=True))
        chance = density[:, s >= threshold].sum(axis=1) / density.sum(axis=1)
        least.append(int(np.argmax(chance >= miss)))
    return np.array(least)


def plausible(sig: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The pairs (positions in i and j) that survive all batches."""
    left, agreed = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, needed in enumerate(least):
        cols = slice(k * _BATCH, (k + 1) * _BATCH)
        agreed = agreed + (sig[i[left], cols] == sig[j[left], cols]).sum(axis=1)
        stay = agreed >= needed
        left, agreed = left[stay], agreed[stay]
        if not len(left):
            break
    return left


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by their first ``keys`` columns; small groups come together."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            col = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= col[1:] != col[:-1]
            if rest:
                change[0] |= col[0] != rest[-1].column(k)[-1].as_py()
        at = np.flatnonzero(change)
        if len(at) == 0:
            rest.append(batch)
            continue
        last = int(at[-1])
        if last or rest:
            yield pa.Table.from_batches([*rest, batch.slice(0, last)] if last else rest)
        rest = [batch.slice(last)]
    if rest:
        yield pa.Table.from_batches(rest)


def _bounds(columns: list[np.ndarray]) -> np.ndarray:
    n = len(columns[0])
    new = np.ones(n + 1, bool)
    new[1:n] = False
    for c in columns:
        new[1:n] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _signature_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _bucket_edges(percent: int):
    least = fewest_agreements(percent / 100)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns bucket, v, n, sig, sorted by bucket."""
        forest = Forest()
        for table in groups(batches, 1):
            v, n = table["v"].to_numpy(), table["n"].to_numpy()
            sig = _signature_matrix(table["sig"])
            ends = _bounds([table["bucket"].to_numpy()])
            a, b = [], []

            def keep(i: np.ndarray, j: np.ndarray) -> None:
                fits = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
                i, j = i[fits], j[fits]
                for x in plausible(sig, i, j, least):
                    p, q = int(v[i[x]]), int(v[j[x]])
                    if forest.join(p, q):
                        a.append(p)
                        b.append(q)

            size = np.diff(ends)
            starts = ends[:-1]
            for d in range(1, 9):  # small buckets, all at once: each vertex with the d-th after it
                small = starts[(size > d) & (size <= 9)]
                reach = size[(size > d) & (size <= 9)] - d
                if len(small):
                    i = np.repeat(small, reach) + np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
                    keep(i, i + d)
            for s, g in zip(starts[size > 9], size[size > 9], strict=True):
                label = np.fromiter((forest.find(int(x)) for x in v[s:s + g]), np.int64, g)
                for k in range(g - 1):
                    if (label == label[0]).all():
                        break
                    later = k + 1 + np.flatnonzero(label[k + 1:] != label[k])
                    if len(later):
                        known = len(a)
                        keep(np.full(len(later), s + k), s + later)
                        if len(a) > known:
                            label = np.fromiter((forest.find(int(x)) for x in v[s:s + g]), np.int64, g)
            if a:
                yield _edges(a, b)

    return compare


def _verify(percent: int, links: bool):
    least = fewest_agreements(percent / 100)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Columns family, block, v, comp, asks, n, sig, shingles, sorted by family and block.

        Of each group, the pairs are compared of which one at least asks and which are not connected
        yet.  Gives (v, smallest v of its component) for all rows, or with ``links`` the pairs
        of components that a confirmed link joins."""
        for table in groups(batches, 2):
            family, block = table["family"].to_numpy(), table["block"].to_numpy()
            v, comp, n = table["v"].to_numpy(), table["comp"].to_numpy(), table["n"].to_numpy()
            asks = table["asks"].to_numpy()
            sig, sets = _signature_matrix(table["sig"]), table["shingles"].combine_chunks()
            ends = _bounds([family, block])
            a, b = [], []
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                opened: dict[int, np.ndarray] = {}

                def of(k: int) -> np.ndarray:
                    if k not in opened:
                        opened[k] = np.frombuffer(sets[k].as_py(), np.uint64)
                    return opened[k]

                # Labels of the group's rows: equal for what is connected.
                label = np.unique(comp[lo:hi], return_inverse=True)[1]
                for k in range(lo, hi):
                    others = np.arange(k + 1, hi) if asks[k] else k + 1 + np.flatnonzero(asks[k + 1:hi])
                    others = others[label[others - lo] != label[k - lo]]
                    fits = 100 * np.minimum(n[k], n[others]) >= percent * np.maximum(n[k], n[others])
                    others = others[fits]
                    others = others[plausible(sig, np.full(len(others), k), others, least)] if len(others) else others
                    for j in others:
                        mine, its = label[k - lo], label[j - lo]
                        if mine == its:
                            continue
                        x, y = of(k), of(int(j))
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            label[label == its] = mine
                            if links:
                                a.append(int(comp[k]))
                                b.append(int(comp[j]))
                if not links:
                    least_v = np.full(hi - lo, np.iinfo(np.int64).max)
                    np.minimum.at(least_v, label, v[lo:hi])
                    a += v[lo:hi].tolist()
                    b += least_v[label].tolist()
            if a:
                yield _edges(a, b)

    return confirm


def _compared(rows: DataFrame, percent: int, links: bool) -> DataFrame:
    columns = ["family", "block", "v", "comp", "asks", "n", "sig", "shingles"]
    dealt = rows.withColumn("asks", F.col("asks").cast("int")).select(columns)
    dealt = dealt.repartition("family", "block").sortWithinPartitions("family", "block", "v")
    return dealt.mapInArrow(_verify(percent, links), "a long, b long")


def _renamed(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` with comp replaced by b where ``names`` (a, b) has it as a."""
    joined = rows.join(names.select(F.col("a").alias("__a"), F.col("b").alias("__b")), F.col("comp") == F.col("__a"), "left")
    return joined.withColumn("comp", F.coalesce("__b", "comp")).drop("__a", "__b")


def exact_classes(members: DataFrame, percent: int) -> DataFrame:
    """v, comp: the class of each vertex, named by a vertex.

    ``members`` (family, v, n, sig, shingles) has each vertex of a family once."""
    counts = members.groupBy("family").agg(F.count(F.lit(1)).alias("__n"))
    # Blocks only spread the work of large families; any assignment gives the same classes.
    place = F.pmod(F.xxhash64("v"), F.ceil(F.col("__n") / BLOCK).cast("long"))
    dealt = members.join(counts, "family").withColumn("block", place).withColumn("comp", F.col("v")).withColumn("asks", F.lit(True))
    own = stage(_compared(dealt, percent, False).select(F.col("a").alias("v"), F.col("b").alias("comp")), "blocks")
    large = counts.filter(F.col("__n") > BLOCK)
    if large.isEmpty():
        return own
    now = stage(members.join(large, "family").join(own, "v"), "families")
    # Representatives of the components found so far meet, until they fit one block or stop getting fewer.
    before = None
    while True:
        heads = now.filter(F.col("v") == F.col("comp"))
        sizes = heads.groupBy("family").agg(F.count(F.lit(1)).alias("__heads"))
        n_heads = sizes.agg(F.max("__heads")).first()[0]
        if n_heads == 1 or (before is not None and (before <= BLOCK or 2 * n_heads > before)):
            break
        before = n_heads
        some = heads.join(sizes.filter(F.col("__heads") > 1), "family")
        spread = F.pmod(F.xxhash64(F.lit(n_heads), "v"), F.ceil(F.col("__heads") / BLOCK).cast("long"))
        some = some.withColumn("block", spread).withColumn("asks", F.lit(True))
        names = stage(_compared(some, percent, False), "heads")
        own, now = _renamed(own, names), stage(_renamed(now, names), "families")
    # Whoever is outside the largest component of its family meets every block of the family.
    by_size = now.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("__c"))
    largest = by_size.groupBy("family").agg(F.max(F.struct("__c", "comp")).alias("__m")).select(
        "family", F.col("__m.comp").alias("__main"), F.col("__m.__c").alias("__main_n"))
    open_ = now.join(largest, "family").filter(F.col("__main_n") < F.col("__n"))
    # Groups are (block of the outsiders, block of all).
    half = max(1, BLOCK // 2)
    seats = F.ceil(F.col("__n") / half).cast("long")
    asking_seats = F.ceil((F.col("__n") - F.col("__main_n")) / half).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asking = open_.filter(F.col("comp") != F.col("__main")).withColumn("__mine", F.pmod(F.xxhash64(F.lit(5), "v"), asking_seats))
    asking = asking.withColumn("__seat", each(seats)).withColumn("asks", F.lit(True))
    asked = open_.withColumn("__seat", F.pmod(F.xxhash64(F.lit(3), "v"), seats)).withColumn("__mine", each(asking_seats))
    final = asking.unionByName(asked.withColumn("asks", F.lit(False))).withColumn("block", F.col("__mine") * seats + F.col("__seat"))
    links = stage(_compared(final, percent, True), "links")
    if links.isEmpty():
        return own
    return _renamed(own, components(links).select(F.col("v").alias("a"), F.col("root").alias("b")))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, doc_id, text_key."""
    for batch in batches:
        step = 2_000
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            n, d1, d2, sig = signatures(part.column(0))
            raw = sig.tobytes()
            width = 4 * HASHES
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), pa.array(n, pa.int64()), pa.array(d1.view(np.int64)),
                 pa.array(d2.view(np.int64)), pa.array([raw[k * width:(k + 1) * width] for k in range(len(n))], pa.binary())],
                ["doc_id", "text_key", "n", "d1", "d2", "sig"],
            )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns text, family, v, n, sig: the same with the sorted shingles instead of the text."""
    for batch in batches:
        sets = []
        for n, row, h in shingle_sets(batch.column(0)):
            at = np.searchsorted(row, np.arange(n + 1))
            sets += [h[at[k]:at[k + 1]].tobytes() for k in range(n)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sets, pa.binary())],
                                         ["family", "v", "n", "sig", "shingles"])


def band_rows(percent: int) -> int:
    """The most hashes in a band with which pairs at the threshold share one, but for ``UNSEEN`` of them."""
    s = percent / 100
    return max(r for r in range(1, HASHES + 1) if HASHES % r == 0 and (r == 1 or (1 - s**r) ** (HASHES // r) <= UNSEEN))


def _bands(sig: str, percent: int):
    """An array of bucket numbers: a hash of each band's bytes and its number."""
    rows = band_rows(percent)
    width = 4 * rows
    return F.array(*[F.xxhash64(F.lit(k), F.substring(sig, 1 + k * width, width)) for k in range(HASHES // rows)])


def classes(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per document; also text_key (MD5 of the
    text), rid (a number of the row) and root (a number of the class, null without words)."""
    texts = docs.select(docs["text"].alias("text"), docs["doc_id"].alias("doc_id"),
                        F.unhex(F.md5(docs["text"])).alias("text_key"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    measured = texts.mapInArrow(_measure, f"doc_id {doc_type}, text_key binary, n long, d1 long, d2 long, sig binary")
    rows = stage(measured.withColumn("rid", F.monotonically_increasing_id()), "signatures")
    # One row of each set, cut down before the shuffle.
    first = F.min(F.struct("rid", "doc_id", "text_key", "n", "sig")).alias("h")
    vertices = rows.filter(F.col("n") > 0).groupBy("d1", "d2").agg(first, F.min("doc_id").alias("first_doc"))
    heads = stage(vertices.select("d1", "d2", "first_doc", F.col("h.rid").alias("v"), "h.doc_id", "h.text_key", "h.n", "h.sig"), "heads")
    seats = heads.select("v", F.explode(_bands("sig", percent)).alias("bucket"))
    # A bucket is one run of a sort; vertices alone in theirs go.
    run = Window.partitionBy("bucket").orderBy("v")
    numbered = seats.select("v", "bucket", F.row_number().over(run).alias("nth"), F.lead("v").over(run).alias("__next"))
    met = stage(numbered.filter((F.col("nth") > 1) | F.col("__next").isNotNull()).drop("__next"), "buckets")
    full = met.filter(F.col("nth") == BUCKET + 1).select(F.col("bucket").alias("__bucket"))
    told = met.join(full, F.col("bucket") == F.col("__bucket"), "left")
    starts = met.filter("nth = 1").join(full, F.col("bucket") == F.col("__bucket")).select("bucket", F.col("v").alias("b"))
    crowded = met.filter("nth > 1").join(starts, "bucket").select(F.col("v").alias("a"), "b").distinct()
    normal = told.filter(F.col("__bucket").isNull()).select("bucket", "v")
    normal = normal.join(heads.select("v", "n", "sig"), "v").select("bucket", "v", "n", "sig")
    tried = normal.repartition("bucket").sortWithinPartitions("bucket", "v").mapInArrow(_bucket_edges(percent), "a long, b long")
    found = stage(crowded.unionByName(tried), "candidates")
    families = components(found).withColumnRenamed("root", "family")
    wanted = heads.join(families, "v").select("family", "v", "n", "sig", F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    fetched = texts.join(wanted, (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    one_each = fetched.select("text", "family", "v", "n", "sig").mapInArrow(
        _full_sets, "family long, v long, n long, sig binary, shingles binary")
    members = stage(one_each, "members")
    # Rows that repeat id and text bring a vertex again.
    if members.count() > families.count():
        members = members.dropDuplicates(["v"])
    roots = exact_classes(members, percent).withColumnRenamed("comp", "root")
    named = heads.select("v", "d1", "d2", "first_doc").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    names = named.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    labels = stage(named.join(names, "root").select(
        F.col("d1").alias("__d1"), F.col("d2").alias("__d2"), "component_id", "root"), "classes")
    of = (F.col("n") > 0) & (F.col("d1") == F.col("__d1")) & (F.col("d2") == F.col("__d2"))
    named_rows = rows.drop("sig").join(labels, of, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return named_rows.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"), "rid", "root") \
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one document of each class, of the smallest id; of rows that repeat id and text one stays."""
    found = stage(classes(docs, percent).filter("kept"), "kept")
    one = found.groupBy(F.coalesce("root", -1 - F.col("rid")).alias("__class")).agg(F.min("rid").alias("__rid"))
    kept = found.join(one, found["rid"] == one["__rid"]).select(
        F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    # Plain keys without nulls: the join leaves its rows where the repeated ones are sought.
    keyed = docs.select(*[docs[c] for c in docs.columns], *_plain_keys(docs["doc_id"], F.unhex(F.md5(docs["text"])), "l"))
    wanted = kept.select(*_plain_keys(F.col("__id"), F.col("__key"), "r")).distinct()
    same = [F.col(f"__l{k}") == F.col(f"__r{k}") for k in range(3)]
    return keyed.join(wanted, same, "left_semi").dropDuplicates([f"__l{k}" for k in range(3)]).select(*[keyed[c] for c in docs.columns])


def _plain_keys(doc_id: Column, text_key: Column, side: str) -> list[Column]:
    nothing = F.coalesce(doc_id, F.lit(0).cast("long"))
    kind = F.when(doc_id.isNull(), 1).otherwise(0) + F.when(text_key.isNull(), 2).otherwise(0)
    return [c.alias(f"__{side}{k}") for k, c in enumerate((nothing, F.coalesce(text_key, F.unhex(F.lit("00"))), kind))]
