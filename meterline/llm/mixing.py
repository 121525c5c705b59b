"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterline.llm import common

#: Weights of the sources in the order of their names, repeating; share of all words; most epochs of a source.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2


def prose_weight() -> Column:
    """Quality weight of a text in [0.25, 1]: its mean word length against that of prose (about 6 characters)."""
    words = F.greatest(F.col("size"), F.lit(1))
    return F.greatest(F.lit(0.25), F.least(F.lit(1.0), 1.25 - F.abs(F.col("_chars") / words - 6.0) / 12.0))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Per source (source, source_size) its target.

    Targets are min(epochs * source_size, level * weight) with one level for all: what a full source leaves goes to the
    others by weight until none is above its limit. The level follows from prefix sums over the sources in the order
    in which they fill up. One row per source: the windows here run over the list of sources, not over documents.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = sizes.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    named = named.withColumn("_cap", F.col("source_size") * F.lit(float(epochs)))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    named = named.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(share)))
    named = named.withColumn("_capped", F.sum("_cap").over(fill)).withColumn("_open", F.sum("_w").over(everything) - F.sum("_w").over(fill))
    # the level if the sources up to this one are full; it holds from the last one that it still fills
    level = F.when(F.col("_open") > 0, (F.col("_total") - F.col("_capped")) / F.col("_open")).otherwise(F.lit(float("inf")))
    first = F.col("_total") / F.sum("_w").over(everything)
    named = named.withColumn("_if", level).withColumn("_first", first)
    following = F.lead(F.col("_cap") / F.col("_w")).over(fill)
    full = F.col("_if") >= F.col("_cap") / F.col("_w")
    stops = full & (following.isNull() | (F.col("_if") < following))
    # with no source full the level is the first one; the last row stops in any case, so this comes before the stops
    smallest = F.min(F.col("_cap") / F.col("_w")).over(everything)
    stopped = F.min(F.when(stops, F.col("_if"))).over(everything)
    named = named.withColumn("_level", F.when(F.col("_first") <= smallest, F.col("_first")).otherwise(F.coalesce(stopped, F.col("_first"))))
    target = F.least(F.col("_cap"), F.col("_level") * F.col("_w"))
    return named.select("source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(target).alias("target"))


def mix_sources(
    docs: DataFrame, weight: Column | None = None, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = 1
) -> DataFrame:
    """Per document doc_id, source, size, source_size, target, taken, and its identity ``_key``.

    A source's target is first served in complete epochs: every document as often as the target holds the source. The
    rest is an Efraimidis-Spirakis sample: exponential keys -ln(u) / weight with u from a hash of the row, in rising
    order, until their summed sizes reach the budget; the document at the edge comes in if that is nearer. Nothing
    depends on partitions, so reruns agree. Only narrow rows are shuffled, and running totals go over ranges of a
    source, so that one source may hold most documents.

    Null or empty texts have size 0 and are never taken; null sources form one source, the last; rows that repeat a
    doc_id and text count each, with one key, and stand next to each other; a null doc_id is hashed by its text; other
    columns are ignored.
    """
    wide = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        common.word_count().alias("size"), F.coalesce(F.length("text"), F.lit(0)).alias("_chars"),
        F.xxhash64("doc_id", "text", F.lit(seed)).alias("_key"),
    )
    u = (F.expr("shiftrightunsigned(_key, 11)") + F.lit(0.5)) / F.lit(float(1 << 53))
    heavy = F.greatest(F.coalesce(weight if weight is not None else prose_weight(), F.lit(0.0)), F.lit(1e-6))
    rows = common.stored(wide.select("doc_id", "source", "size", "_key", (-F.ln(u) / heavy).alias("_order")), "sizes")
    goals = common.stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    ranked = common.running_total(rows, ["source"], ["_order", "_key", "doc_id", "size"], "size", "_before")
    by_source = goals.select(F.col("source").alias("_s"), "source_size", "target")
    joined = ranked.join(by_source, F.col("source").eqNullSafe(F.col("_s")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(F.lit(0))
    budget = F.col("target") - F.col("_whole") * F.col("source_size")
    drawn = (F.col("_whole") < epochs) & (F.col("_before") + F.col("size") / 2 <= F.col("_budget"))
    taken = F.col("size") * (F.col("_whole") + drawn.cast("long"))
    return joined.withColumn("_whole", whole.cast("long")).withColumn("_budget", budget).select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), "_key"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (not at all, once, twice); columns unchanged.

    Rows that repeat doc_id, text and source are interchangeable. Only such a group that lies across the edge of its
    source's budget is taken in part, one group a source at most: its rows are numbered, over ranges, and the first ones
    taken once more. The row's own columns travel as one struct, so none can clash.
    """
    mixed = mix_sources(docs, **options).where("size > 0").withColumn("times", F.col("taken") / F.col("size"))
    times = mixed.groupBy(F.col("_key").alias("key"), F.col("doc_id").alias("id"), F.col("source").alias("of")).agg(
        F.min("times").cast("int").alias("least"), F.max("times").cast("int").alias("most"),
        F.sum("times").cast("long").alias("total"), F.count(F.lit(1)).alias("rows"),
    ).where("most > 0")
    times = common.stored(times, "times")
    keyed = docs.select(
        F.xxhash64("doc_id", "text", F.lit(options.get("seed", 1))).alias("key0"), F.col("doc_id").cast("long").alias("id0"),
        F.col("source").cast("string").alias("of0"), F.struct("*").alias("row"),
    )
    same = (F.col("key0") == F.col("key")) & F.col("id0").eqNullSafe(F.col("id")) & F.col("of0").eqNullSafe(F.col("of"))
    whole = keyed.join(times.where("least = most"), same).select("row", F.col("most").alias("copies"))
    edge = keyed.join(times.where("least < most"), same).withColumn("one", F.lit(1).cast("long"))
    edge = edge.withColumn("tie", F.monotonically_increasing_id())
    edge = common.running_total(edge, ["key", "id", "of"], ["tie"], "one", "nth")
    more = (F.col("nth") < F.col("total") - F.col("least") * F.col("rows")).cast("int")
    copies = whole.unionByName(edge.select("row", (F.col("least") + more).alias("copies"))).where("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
