"""Personal data: spans by pattern, and terms that reveal them by what they share with the corpus.

Base spans are the leftmost, non-overlapping matches of four patterns, each checked
(:func:`valid`); every distinct value found is a protected entity.  The words of any length, with
letters or digits, of all documents that hold an entity are its terms.  With documents as events, a
term t tells

    PMI(e; t) = log2(n * n_et / (n_e * n_t))

bits of the log2(n / n_e) bits that identify entity e: n_et documents have both, n_e
have e and n_t have t, anywhere in the text and counted over all documents.  A term that tells ``SHARE`` of the bits
or more discloses the entity, however often the two occur.  Wherever the term occurs in a document that
holds the entity, it is generalised to its first letters if these are shorter and tell less than that
of every such entity, and removed otherwise.

Everything is DataFrame functions.  Positions are code points; they come from the text between the
matches (a split by the same pattern) and running sums over a document's matches.  The patterns
read every character a bounded number of times: matches of maximal runs are possessive, and a
run is tried at its first character only, or where the match before ended.

Nulls and edge cases: null and empty texts have no spans; null or repeated ids are rows like any
other; an empty table gives no rows.  Columns besides ``doc_id`` and ``text`` may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.llm.common import stage

#: The kinds in order, and their patterns.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a pattern cannot match.
_NEEDED = {"email": "@", "ip": ".", "phone": "+"}
TERM = "term"
SHARE, PREFIX = 0.9, 3
#: A word: letters with their marks, and digits.
WORD = r"[\p{L}\p{M}\p{N}]++"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    places = F.sequence(F.lit(1), F.length(digits))

    def weight(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(places, weight), F.lit(0), lambda a, x: a + x) % 10 == 0


def valid(kind: Column, match: Column) -> Column:
    number = _digits(match)
    small = F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    card = F.when(F.length(number).between(13, 19), luhn(number)).otherwise(False)
    return (
        F.when(kind == "ip", small).when(kind == "card", card)
        .when(kind == "phone", F.length(number).between(9, 15)).otherwise(True)
    )


def _found(text: Column, kind: str) -> Column:
    """The matches in order: characters since the match before, and the match if it is valid."""
    between = F.split(text, PATTERNS[kind], -1)
    every = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    parts = F.transform(F.arrays_zip(between.alias("gap"), every.alias("match")), lambda z: F.struct(
        F.char_length(z["gap"]).alias("gap"), F.char_length(z["match"]).alias("length"),
        F.when(valid(F.lit(kind), z["match"]), z["match"]).alias("match")))
    matches = F.filter(parts, lambda p: p["length"].isNotNull())
    possible = text.contains(_NEEDED[kind]) if kind in _NEEDED else text.rlike("[0-9]")
    return F.when(possible & F.exists(matches, lambda p: p["match"].isNotNull()), matches)


def candidates(docs: DataFrame, whole: bool = False) -> DataFrame:
    """rid, doc_id, the matches of each kind, and text, of documents that hold an entity (or of all, if ``whole``):
    written, so that rid stays and no text has to meet its matches again."""
    text = F.coalesce(docs["text"], F.lit(""))
    found = docs.select(
        F.monotonically_increasing_id().alias("rid"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"),
        *[_found(text, kind).alias(f"m_{kind}") for kind in PATTERNS],
    ).withColumn("held", F.coalesce(*[F.size(f"m_{kind}") > 0 for kind in PATTERNS], F.lit(False)))
    return stage(found if whole else found.withColumn("text", F.when(F.col("held"), F.col("text"))), "pii-matches")


def base_spans(found: DataFrame) -> DataFrame:
    """rid, kind, rank (the kind's place), start, end, entity."""
    each = reduce(DataFrame.unionByName, [
        found.select("rid", F.lit(kind).alias("kind"), F.lit(k).alias("rank"), F.posexplode(f"m_{kind}").alias("nth", "m"))
        for k, kind in enumerate(PATTERNS)
    ])
    order = Window.partitionBy("rid", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.col("m.length")).over(order)
    placed = each.select("rid", "kind", "rank", (end - F.col("m.length")).alias("start"), end.alias("end"), "m.match")
    ok = placed.filter(F.col("match").isNotNull())
    plain = F.when(F.col("kind") == "email", F.lower("match")).when(F.col("kind") == "ip", F.col("match")).otherwise(_digits(F.col("match")))
    return ok.withColumn("entity", F.concat("kind", F.lit(":"), plain)).drop("match")


def _listed_words(text: str) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def terms_of(found: DataFrame) -> DataFrame:
    """rid, term: the distinct words of the documents that hold an entity."""
    once = F.array_distinct(F.transform(F.array_distinct(_listed_words("text")), F.lower))
    return found.filter("held").select("rid", F.explode(once).alias("term"))


def places(found: DataFrame, told: DataFrame) -> DataFrame:
    """rid, start, end, generalised: where the terms of ``told`` (rid, term, generalised) are in their documents."""
    by_doc = told.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "generalised"))).alias("told"))
    held = found.filter("held").select("rid", "text").join(by_doc, "rid")
    parts = F.transform(F.arrays_zip(F.split("text", WORD, -1).alias("gap"), _listed_words("text").alias("word")),
                        lambda z: F.struct(F.char_length(z["gap"]).alias("gap"), F.char_length(z["word"]).alias("length"),
                                           F.try_element_at(F.col("told"), F.lower(z["word"])).alias("generalised")))
    each = held.select("rid", F.posexplode(F.filter(parts, lambda p: p["length"].isNotNull())).alias("nth", "w"))
    order = Window.partitionBy("rid").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("w.gap") + F.col("w.length")).over(order)
    placed = each.select("rid", (end - F.col("w.length")).alias("start"), end.alias("end"), "w.generalised")
    return placed.filter(F.col("generalised").isNotNull())


def _prefix(term: Column) -> Column:
    return F.concat(F.left(term, F.lit(PREFIX)), F.lit("*"))


def document_counts(docs: DataFrame) -> DataFrame:
    """term, n_t: in how many documents each word, and each word's beginning (with a ``*``), occurs."""
    every = F.array_distinct(F.regexp_extract_all(docs["text"], F.lit(WORD), F.lit(0)))
    listed = docs.filter(docs["text"].isNotNull()).select(F.array_distinct(F.transform(every, F.lower)).alias("w"))
    both = F.concat(F.col("w"), F.array_distinct(F.transform("w", _prefix)))
    return listed.select(F.explode(both).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))


def owners_of(spans: DataFrame) -> DataFrame:
    """rid, g, n_e: the groups of entities in each document.

    Entities found in the same documents have the same counts with every term and are one group, named by
    128 bits of their documents; so many entities of a single document count once."""
    each = spans.select("rid", "entity").distinct()
    seen = each.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_e"), F.bit_xor(F.xxhash64("rid")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "rid")).alias("y"))
    return each.join(seen, "entity").select("rid", F.struct("n_e", "x", "y").alias("g"), "n_e").distinct()


def _telling(terms: DataFrame, owners: DataFrame, n: float, share: float) -> DataFrame:
    """rid, g, term of the terms (rid, term, n_t) that tell ``share`` of the bits of a group of entities of their document.

    A term of one document (n_t = 1) tells all bits of all its entities, so it needs no count."""
    known = owners.filter(F.col("n_e") < n)
    # n_et is n_e at most, so a term in more documents than this tells too little whatever n_et is.
    pairs = terms.join(known, "rid").filter(F.col("n_t") <= n ** (1 - share) * F.pow("n_e", F.lit(share)) * 1.001)
    alone = pairs.filter("n_t = 1").select("rid", "g", "term")
    shared = stage(pairs.filter("n_t > 1"), "pii-pairs")
    told = shared.groupBy("g", "term").agg(F.count(F.lit(1)).alias("n_et"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    bits, whole = F.log2(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), F.log2(F.lit(n) / F.col("n_e"))
    enough = told.filter(bits >= share * whole).select("g", "term")
    return alone.unionByName(shared.select("rid", "g", "term").join(enough, ["g", "term"]).select("rid", "g", "term"))


def disclosing(found: DataFrame, spans: DataFrame, docs: DataFrame, share: float) -> DataFrame:
    """rid, term, generalised: the terms that tell too much of an entity of the document, and whether
    their beginning does not."""
    n = float(docs.count())
    owners = stage(owners_of(spans), "pii-owners")
    most_e = owners.agg(F.max("n_e")).first()[0] or 0
    most_t = n ** (1 - share) * most_e ** share * 1.001
    counts = stage(document_counts(docs).filter(F.col("n_t") <= most_t), "pii-counts")
    terms = stage(terms_of(found).join(counts, "term"), "pii-terms")
    telling = stage(_telling(terms, owners, n, share), "pii-telling")
    # Beginnings matter only where a longer term tells.
    longer = telling.filter(F.char_length("term") > PREFIX).select("rid", _prefix(F.col("term")).alias("term")).distinct()
    asked = longer.select("term").distinct()
    wanted = terms_of(found).select("rid", _prefix(F.col("term")).alias("term")).join(asked, "term", "left_semi").distinct()
    short = _telling(wanted.join(counts, "term"), owners, n, share).select(
        F.col("rid").alias("__rid"), F.col("g").alias("__g"), F.col("term").alias("__short"))
    same = (F.col("rid") == F.col("__rid")) & (F.col("g") == F.col("__g")) & (_prefix(F.col("term")) == F.col("__short"))
    # A word no longer than its beginning cannot be generalised.
    told_less = F.col("__short").isNull() & (F.char_length("term") > PREFIX)
    return telling.join(short, same, "left").groupBy("rid", "term").agg(F.min(told_less).alias("generalised"))


def all_spans(found: DataFrame, docs: DataFrame, share: float = SHARE) -> DataFrame:
    """rid, kind, rank, start, end, generalised: base spans, and terms outside them."""
    spans = stage(base_spans(found), "pii-spans")
    terms = places(found, disclosing(found, spans, docs, share))
    base = spans.select("rid", "kind", "rank", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"),
                        F.lit(None).cast("boolean").alias("generalised"))
    added = terms.select("rid", F.lit(TERM).alias("kind"), F.lit(len(PATTERNS)).alias("rank"),
                         F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "generalised")
    both = base.unionByName(added)
    # A term inside a base span is part of it.
    of = Window.partitionBy("rid").orderBy("start", "rank")
    is_base = F.col("kind") != TERM
    covered = F.max(F.when(is_base, F.col("end"))).over(of.rowsBetween(Window.unboundedPreceding, -1))
    coming = F.min(F.when(is_base, F.col("start"))).over(of.rowsBetween(1, Window.unboundedFollowing))
    overlap = (F.coalesce(covered, F.lit(-1)) > F.col("start")) | (F.coalesce(coming, F.col("end")) < F.col("end"))
    return both.withColumn("__in", ~is_base & overlap).filter(~F.col("__in")).drop("__in")


def find(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """rid, doc_id, spans: per document an array of (rank, start, end, kind, generalised), sorted."""
    found = candidates(docs)
    return _gathered(found.select("rid", "doc_id"), all_spans(found, docs, share)).select("rid", "doc_id", "spans")


def _gathered(found: DataFrame, spans: DataFrame) -> DataFrame:
    lists = spans.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end", "kind", "generalised"))).alias("spans"))
    joined = found.join(lists, "rid", "left")
    none = F.array().cast("array<struct<rank:int,start:bigint,end:bigint,kind:string,generalised:boolean>>")
    return joined.withColumn("spans", F.coalesce("spans", none))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitise(docs: DataFrame, share: float = SHARE) -> DataFrame:
    """doc_id, text, sanitised: entities become their kind in brackets, terms their beginning or nothing."""
    found = candidates(docs, whole=True)
    gathered = _gathered(found, all_spans(found, docs, share))
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["rank"], s["kind"], s["generalised"])))
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(a: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.greatest(s["start"] - a["at"], F.lit(0)).cast("int"))
        beginning = F.concat(F.substring(F.col("text"), (s["start"] + 1).cast("int"), F.lit(PREFIX)), F.lit("*"))
        shown = F.when(s["kind"] != TERM, F.concat(F.lit("["), s["kind"], F.lit("]"))).when(s["generalised"], beginning).otherwise("")
        shown = F.when(s["end"] <= a["at"], "").otherwise(shown)  # inside the span before
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["parts"], F.array(F.concat(gap, shown))).alias("parts"))

    rest = F.aggregate(by_start, state, step, lambda a: F.concat(
        F.array_join(a["parts"], ""), F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))))
    return gathered.select("doc_id", "text", F.when(F.col("text").isNotNull(), rest).alias("sanitised"))
