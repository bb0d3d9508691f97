"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words (:func:`targets`).  Of a source with target t
and size s, each document is first taken floor(t / s) times; what is left of the
target is filled by an order sample of fixed size: document i is to be included with probability

    p_i = min(1, level * measure(size_i)),

where the source's level makes the expected words, the sum of p_i * size_i, equal to the words left
(:func:`levels`).  It draws u, ranks by the odds of u over its inclusion odds p_i / (1 - p_i), and the lowest ranks
are taken until the words left are used up; documents with p_i = 1 come first.  Where the next document
would overshoot, the gap is filled by a second cut among the later documents of at most a
quarter of the gap.

The cut is found without sorting a source: two rounds of histograms over the
ranks (4,096 cells each, whatever the size of the source), then one window over
the rows of a single cell of a cell.

Nulls and edge cases: a null source is a source; a null text has size 0; documents
of size 0 are taken with the whole copies of their source only; sources of size 0
have target 0; draws depend on doc_id and text, so repeated rows (same id, same
text) are taken or left together; an empty table gives an empty mix.  Columns
besides ``doc_id``, ``text`` and ``source`` may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemend.llm.common import WORD, stage, uniform

CELLS = 4096
#: Up to so many sources (a few MB), what is known per source is broadcast; beyond, the engine chooses the join.
FEW_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """source, source_size, target: ``share`` of all words dealt out by weight.

    ``sizes`` has one row per source (source, source_size).  Weights repeat over the
    sources by code point, null last.  A target stops at ``most`` times its source's
    size, and the excess is dealt out again by weight until none is above: targets
    are min(most * size, weight * level), and the level follows from the running
    sums over the sources in the order in which they fill up.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__at") % len(weights) + 1).cast("int"))
    weighed = (
        sizes.withColumn("__at", F.row_number().over(ordered) - 1)
        .withColumn("__w", weight).withColumn("__cap", F.lit(float(most)) * F.col("source_size"))
    )
    filling = Window.orderBy(F.col("__cap") / F.col("__w"), "__at")
    everything = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.coalesce(F.sum("__cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("__w").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    return (
        weighed.withColumn("__level", (total - full) / open_weight)
        .withColumn("__level", F.max("__level").over(everything))
        .select("source", "source_size", F.least("__cap", F.col("__w") * F.col("__level")).alias("target"))
    )


Measure = Callable[[Column], Column]


def drawn(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with __size, and __draw inside (0, 1)."""
    draw = uniform(F.lit(seed), docs["doc_id"], docs["text"])
    return docs.withColumn("__size", word_count(docs["text"])).withColumn("__draw", draw)


def _measured(size: Column, measure: Measure) -> Column:
    return measure(F.greatest(size, F.lit(1)).cast("double"))


def levels(sizes: DataFrame, measure: Measure) -> DataFrame:
    """source, __level: what makes the sum of min(1, level * measure(size)) * size the words left of each source.

    ``sizes`` has one row per source and distinct size (source, __size, __n, __rest).  Sizes reach 1 in falling order of
    their measure, so the level follows from running sums; a source of w words has at most sqrt(2 w) distinct sizes.
    """
    words = F.col("__size") * F.col("__n")
    weighed = sizes.withColumn("__m", _measured(F.col("__size"), measure)).withColumn("__words", words)
    filling = Window.partitionBy("source").orderBy(F.col("__m").desc(), "__size")
    full = F.coalesce(F.sum("__words").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum(F.col("__words") * F.col("__m")).over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return weighed.withColumn("__level", (F.col("__rest") - full) / open_weight).groupBy("source").agg(F.max("__level").alias("__level"))


def _ranked(rows: DataFrame, measure: Measure) -> DataFrame:
    """``rows`` (with __size, __draw, __level) with __p, and __rank: the odds of the draw over the inclusion odds,
    squeezed into [0, 1]; null where the source has no words left to fill."""
    p = F.least(F.lit(1.0), F.col("__level") * _measured(F.col("__size"), measure))
    missed, met = F.col("__draw") * (1 - F.col("__p")), (1 - F.col("__draw")) * F.col("__p")
    return rows.withColumn("__p", F.when(F.col("__level").isNotNull(), p)).withColumn("__rank", missed / (missed + met))


def _cell(df: DataFrame, position: Column, left: str, name: str) -> DataFrame:
    """Per source, the cell in which the running words reach ``left``, with the words before it."""
    cells = df.groupBy("source", _cell_of(position).alias(name)).agg(
        F.sum("__size").alias("__n"), F.first(left).alias("__left")
    )
    upto = Window.partitionBy("source").orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = cells.withColumn("__upto", F.sum("__n").over(upto)).filter(F.col("__upto") >= F.col("__left"))
    return run.groupBy("source").agg(F.min(F.struct(name, (F.col("__upto") - F.col("__n")).alias("before"))).alias("__c")) \
        .select("source", F.col(f"__c.{name}").alias(name), F.col("__c.before").alias("__before"))


def plan(docs: DataFrame, weights: Sequence[float], share: float, most: float,
         measure: Measure = F.sqrt, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(narrow table of the documents, one row per source with its whole copies, its level and its cut)."""
    narrow = stage(drawn(docs.select("doc_id", "text", "source"), seed).drop("text"), "mix-draws")
    counted = stage(narrow.groupBy("source", "__size").agg(F.count(F.lit(1)).alias("__n")), "mix-sizes")
    sizes = counted.groupBy("source").agg(F.sum(F.col("__size") * F.col("__n")).alias("source_size"))
    goal = targets(sizes, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    goal = goal.withColumn("__whole", whole.cast("long"))
    goal = stage(goal.withColumn("__rest", F.col("target") - F.col("__whole") * F.col("source_size")), "mix-targets")

    few = goal.count() <= FEW_SOURCES
    open_ = goal.filter(F.col("__rest") > 0).select("source", "__rest")
    known = levels(_join(counted.filter(F.col("__size") > 0), open_, few), measure)
    goal = stage(_same(goal, known), "mix-levels")
    level = goal.filter(F.col("__level").isNotNull()).select("source", "__level")
    rows = _ranked(_join(narrow.filter(F.col("__size") > 0), level, few), measure)
    rows = stage(rows.select("source", "__size", "__rank"), "mix-ranks")
    first = stage(_cut(rows, open_, 0.0, few), "mix-cuts")
    gaps = _same(open_, first).withColumn("__rest", F.col("__rest") - F.col("__used"))
    # What the next document overshoots is filled with documents of a quarter of the gap or less, in rank order.
    gaps = gaps.filter(F.col("__rest") > 0).withColumn("__limit", F.col("__rest") / 4)
    later = _join(rows, gaps.select("source", "__cut", "__limit"), few).filter(
        (F.col("__rank") > F.col("__cut")) & (F.col("__size") <= F.col("__limit"))
    )
    second = _cut(later.select("source", "__size", "__rank"), gaps.select("source", "__rest"), 0.5, few)
    cuts = _same(goal, first.select("source", "__cut"))
    cuts = _same(cuts, gaps.select("source", "__limit"))
    cuts = _same(cuts, second.select("source", F.col("__cut").alias("__fill")))
    return narrow, stage(cuts.drop("__rest"), "mix-cuts")


def _cut(rows: DataFrame, goals: DataFrame, part: float, few: bool) -> DataFrame:
    """source, __cut, __used: ranks up to __cut hold about __rest words.

    The last rank counts if all but ``part`` of its words fit.  Where all rows together
    hold fewer words, the cut lies above every rank.
    """
    first = F.col("__rank") * CELLS
    second = (first - F.floor(first)) * CELLS
    one = stage(_same(goals, _cell(_join(rows, goals, few), first, "__rest", "__c1")), "mix-cells")
    inner = one.withColumn("__rest", F.col("__rest") - F.coalesce("__before", F.lit(0))).drop("__before")
    hit = _join(rows, inner, few).filter(_cell_of(first) == F.col("__c1"))
    two = stage(_same(inner, _cell(hit, second, "__rest", "__c2")), "mix-cells")
    last = two.withColumn("__rest", F.col("__rest") - F.coalesce("__before", F.lit(0))).drop("__before")
    near = _join(rows, last, few).filter((_cell_of(first) == F.col("__c1")) & (_cell_of(second) == F.col("__c2")))
    equal = near.groupBy("source", "__rank").agg(F.sum("__size").alias("__n"), F.first("__rest").alias("__rest"))
    upto = Window.partitionBy("source").orderBy("__rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = F.col("__upto") - F.col("__n") * part <= F.col("__rest")
    ends = equal.withColumn("__upto", F.sum("__n").over(upto)).groupBy("source").agg(
        F.max(F.when(fits, F.col("__rank"))).alias("__in"),
        F.max(F.when(fits, F.col("__upto"))).alias("__words"),
    )
    # Where not even the first rank of the cell fits, the cut lies at the cell's lower end.
    low = (F.col("__c1") + F.col("__c2") / CELLS) / CELLS
    used = F.col("__goal") - F.col("__rest") + F.coalesce("__words", F.lit(0))
    found = _same(_same(last, ends), goals.select("source", F.col("__rest").alias("__goal")))
    cut = F.when(F.col("__c1").isNull(), F.lit(2.0)).otherwise(F.coalesce("__in", low - 1e-12))
    return found.select("source", cut.alias("__cut"), used.alias("__used"))


def _cell_of(position: Column) -> Column:
    return F.least(F.floor(position), F.lit(CELLS - 1))


def _join(rows: DataFrame, bounds: DataFrame, few: bool) -> DataFrame:
    b = bounds.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(b) if few else b, rows["source"].eqNullSafe(b["__source"])).drop("__source")


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.withColumnRenamed("source", "__source")
    return left.join(r, left["source"].eqNullSafe(r["__source"]), "left").drop("__source")


def _copies() -> Column:
    filling = (F.col("__size") <= F.col("__limit")) & (F.col("__rank") <= F.col("__fill"))
    sampled = (F.col("__rank") <= F.col("__cut")) | F.coalesce(filling, F.lit(False))
    picked = F.coalesce((F.col("__size") > 0) & sampled, F.lit(False)).cast("long")
    return (F.col("__whole") + picked).cast("long")


def _attach(rows: DataFrame, cuts: DataFrame, measure: Measure) -> DataFrame:
    c = cuts.withColumnRenamed("source", "__source")
    joined = rows.join(F.broadcast(c) if cuts.count() <= FEW_SOURCES else c, rows["source"].eqNullSafe(c["__source"]), "left")
    return _ranked(joined, measure).withColumn("__copies", _copies())


def mix_plan(docs: DataFrame, weights: Sequence[float], share: float, most: float,
             measure: Measure = F.sqrt, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken, inclusion: one row per document.

    ``inclusion`` is the stated probability of the last copy, null where whole copies meet the target."""
    narrow, cuts = plan(docs, weights, share, most, measure, seed)
    taken = F.col("__copies") * F.col("__size")
    return _attach(narrow, cuts, measure).select(
        "doc_id", F.col("__size").alias("size"), "source_size", "target",
        F.col("__copies").alias("copies"), taken.alias("taken"), F.when(F.col("__size") > 0, F.col("__p")).alias("inclusion"),
    )


def mix(docs: DataFrame, weights: Sequence[float], share: float, most: float,
        measure: Measure = F.sqrt, seed: int = 1) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of ``docs``."""
    _, cuts = plan(docs, weights, share, most, measure, seed)
    rows = _attach(drawn(docs, seed), cuts, measure)
    repeated = F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))
    return rows.select(*[docs[c] for c in docs.columns], repeated.alias("__copy")).drop("__copy")
