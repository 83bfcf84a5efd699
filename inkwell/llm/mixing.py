"""Mixing sources to target weights by Pareto order sampling.

A source's target over its size is the number of copies each of its documents should have on average.
The whole part of it is certain: every document is taken that often.  For the rest, each document has
the fraction as its inclusion probability; documents are ranked by the odds of a random number divided
by their inclusion odds, and the sample is the front of that order whose words make up what the target
lacks.  The sample's size is fixed in words, so the last place goes to the document further down that
fits the remaining words best.

No source is ever sorted in one task: ranks are counted in ``BINS`` bins per source first, and only the
bin in which the sample ends is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import free_name, word_count, written

#: Bins of the rank order of a source.
BINS = 4096
#: Weights that the sources get in turn, and the share of all words that the mix has.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2


def _source_key() -> Column:
    """The source as a text that is never null; null has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def draw(seed: str) -> Column:
    """Random number in (0, 1), fixed by the seed, the doc_id and the text."""
    of = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return (F.conv(F.substring(F.md5(of.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """Words that each source should give: ``key``, ``source_size``, ``target``.

    sizes: ``key`` (source, see ``_source_key``) and ``size``.  A source of size 0 has the target 0.  Sources
    are ordered by code point, null last, and weigh ``WEIGHTS`` in turn; they share ``SHARE`` of all words by
    weight, at most ``MOST`` times their size, and what is above goes to the others by weight.  In the order of
    size over weight, the first sources are full and the others share the rest; this finds where that turns.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy((F.col("key") == "").cast("int"), F.col("key"))) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn % len(WEIGHTS) + 1).cast("int")).cast("double")
    per = per.select("key", "source_size", weight.alias("w"), (F.col("source_size") * float(MOST)).alias("most"))
    by_fill = Window.orderBy(F.col("most") / F.col("w"), "key")
    everything = Window.partitionBy()
    full = F.coalesce(F.sum("most").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * SHARE - full) / F.sum("w").over(
        by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    per = per.withColumn("level", level)
    turns = F.struct((F.col("most") / F.col("w")).alias("fill"), "key", "level")
    water = F.min(F.when(F.col("level") * F.col("w") <= F.col("most"), turns)).over(everything)["level"]
    return per.select("key", "source_size", F.least("most", F.coalesce(water * F.col("w"), "most")).alias("target"))


def plan(units: DataFrame) -> DataFrame:
    """What is taken of each source: ``key``, ``source_size``, ``target``, ``whole``, ``chance``, ``last``,
    ``below``, ``closing``.

    units: ``key``, ``u`` (the random number), ``size``; rows of one ``u`` are one unit.  A document is taken
    ``whole`` times, and once more if its rank is at most ``last`` (where that is null: its bin is before
    ``below``) or equals ``closing``.
    """
    goal = targets(units)
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.withColumn("whole", F.floor(copies).cast("int"))
    goal = goal.withColumn("lack", F.col("target") - F.col("whole") * F.col("source_size"))
    chance = F.when(F.col("source_size") > 0, F.col("lack") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = written(goal.withColumn("chance", chance), "targets")
    ranked = units.where("size > 0").join(goal.where("chance > 0").select("key", "chance"), "key").select(
        "key", "size", rank(F.col("u"), F.col("chance")).alias("rank")
    )
    ranked = written(ranked.withColumn("bin", F.floor(F.col("rank") / (F.col("rank") + 1) * BINS).cast("int")), "ranked")
    upto = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bins = ranked.groupBy("key", "bin").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("upto", F.sum("words").over(upto)).join(goal.select("key", "lack"), "key")
    ends = bins.where("upto - words <= lack AND upto > lack").select(
        "key", "bin", (F.col("upto") - F.col("words")).alias("before"), "lack"
    )
    ends = written(ends, "ends")
    in_order = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranked.join(ends, ["key", "bin"]).withColumn("upto", F.col("before") + F.sum("size").over(in_order))
    fronts = inside.where("upto <= lack").groupBy("key").agg(F.max("rank").alias("last"), F.max("upto").alias("taken"))
    # where nothing of the last bin fits, ``last`` stays null: all earlier bins are the front
    fronts = ends.join(fronts, "key", "left").select(
        "key", "bin", "last", (F.col("lack") - F.coalesce("taken", "before")).alias("left")
    )
    fronts = written(fronts, "fronts")
    behind = F.when(F.col("last").isNull(), F.col("ranked.bin") >= F.col("fronts.bin")).otherwise(F.col("rank") > F.col("last"))
    rest = ranked.alias("ranked").join(fronts.alias("fronts"), "key").where(behind)
    fit = rest.groupBy("key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "rank")).alias("best"))
    chosen = fronts.join(fit, "key", "left").select(
        "key", "last", "bin", F.when(F.col("best.off") < F.col("left"), F.col("best.rank")).alias("closing")
    )
    done = goal.join(chosen, "key", "left").select(
        "key", "source_size", "target", "whole", "chance", "last", F.when(F.col("last").isNull(), F.col("bin")).alias("below"),
        "closing",
    )
    return written(done, "plan")


def rank(u: Column, chance: Column) -> Column:
    """Pareto rank: odds of the random number over the odds of inclusion; null where the chance is 0."""
    return F.try_divide(u / (1 - u), chance / (1 - chance))


def _copies(u: Column, plan_row: str = "") -> Column:
    """Copies of a document, from its source's row of ``plan`` (columns, or the struct ``plan_row``)."""
    whole, chance, last, below, closing = (
        F.col(f"{plan_row}.{n}" if plan_row else n) for n in ("whole", "chance", "last", "below", "closing")
    )
    own = rank(u, chance)
    front = F.when(below.isNotNull(), F.floor(own / (own + 1) * BINS) < below).otherwise(own <= last)
    more = F.coalesce(front, F.lit(False)) | F.coalesce(own == closing, F.lit(False))
    return whole + F.when((chance > 0) & more, 1).otherwise(0)


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Words that the mix takes of every document: ``doc_id``, ``size``, ``source_size``, ``target``, ``taken``.

    Reads doc_id, text and source.  The same rows and seed give the same mix, whatever the partitions.
    Defined cases: null and empty texts have size 0 and nothing of them is taken; the null source is a source
    of its own, last in order; documents that agree in id, source and text share one draw, so all or none of
    them are taken once more; a source or table without words gives targets of 0; an empty table gives an
    empty table; other columns are not read.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), _source_key().alias("key"), word_count(F.col("text")).alias("size"), draw(seed).alias("u")
    )
    rows = written(rows, "sizes")
    units = rows.groupBy("key", "u").agg(F.sum("size").alias("size"))
    found = rows.join(plan(units), "key")
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("u"))).alias("taken"))


def mixed(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns.

    Only each source's few figures are joined to the texts.  Documents without a word are not taken.
    """
    rows = docs.select(_source_key().alias("key"), word_count(F.col("text")).alias("size"), draw(seed).alias("u"))
    units = written(rows.groupBy("key", "u").agg(F.sum("size").alias("size")), "units")
    key, copies, one = (free_name(docs, f"inkwell_{n}") for n in ("key", "copies", "one"))
    counts = plan(units).select(
        F.col("key").alias(key), F.struct("whole", "chance", "last", "below", "closing").alias(copies)
    )
    joined = docs.withColumn(key, _source_key()).join(counts, key)
    times = F.when(word_count(F.col("text")) > 0, _copies(draw(seed), copies)).otherwise(0)
    return joined.withColumn(one, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)
