"""Mixes sources to target weights with hash-threshold histograms; DataFrame functions only.

Every document has a 60-bit hash. A source takes each document `floor(target / size)` times, and once more where the hash
lies under the source's threshold. The threshold comes from histograms: sizes summed by source and hash bucket, the bucket
in which the budget runs out found by a running sum over buckets, and that bucket alone refined by the next bits. Four
levels reach the last bit, so nothing is sorted.

The document at the threshold no longer fits. The same goes on behind it with the documents that fit what is left of the
budget, up to ROUNDS times, so a long document doesn't end its source. Last, the document that comes nearest to the rest is
taken, if the source is nearer to its target with it than without.

Defined cases: null text has size 0; documents of size 0 are taken 0 words; a null source is a source of its own, last in
order; rows equal in id and text have one hash and are taken alike (all of them or none);
a source whose documents are all empty has target 0. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import broadcast_if_small, columns_clear_of, stage, word_count

HASH_BITS = 60
LEVEL_BITS = (12, 12, 12, 24)
ROUNDS = 4
END = (1 << 62) - 1  # above all hashes


def hash_bits(id_column: str, text_column: str) -> Column:
    """60 bits of an MD5 of id and text, as a long."""
    text = F.md5(F.coalesce(F.col(text_column), F.lit("")).cast("binary"))
    whole = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit("/"), text).cast("binary"))
    return F.conv(F.substring(whole, 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], most_repeats: int) -> DataFrame:
    """(source, source_size) -> (source, source_size, target): one row per source throughout.

    Shares by weight; a target stops at most_repeats * source_size and the excess is shared anew by weight until none is above.
    With sources ordered by cap / weight the capped ones come first, so running sums give the final share per weight.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("place", F.row_number().over(in_order) - 1).withColumn(
        "weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    )
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    shared = weighted.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(whole) - most_repeats * F.coalesce(F.sum("source_size").over(by_ratio), F.lit(0))).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))).alias("weights_left"),
    )
    share = F.col("left").cast("double") / F.col("weights_left")
    fits = share * F.col("weight") <= most_repeats * F.col("source_size")
    # the first source in order that fits: it has the most weight left
    final = shared.withColumn("share", F.max_by(F.when(fits, share), F.when(fits, F.col("weights_left"))).over(whole))
    return final.select(
        "source", "source_size",
        F.coalesce(
            F.least(F.col("share") * F.col("weight"), (most_repeats * F.col("source_size")).cast("double")), F.lit(0.0)
        ).alias("target"),
    )


def _refine(narrow: DataFrame, open_sources: DataFrame, level: int) -> DataFrame:
    """One histogram level. open_sources: (source, prefix, budget, low, rest); returns them with the prefix grown by this
    level's bits, the budget that is left before it, and what lies in it."""
    before, bits = sum(LEVEL_BITS[:level]), LEVEL_BITS[level]
    prefix = F.shiftright("hash", HASH_BITS - before) if before else F.lit(0).cast("long")
    inside = narrow.withColumn("prefix", prefix).join(
        open_sources.withColumnsRenamed({"source": "at", "prefix": "at_prefix"}),
        F.col("source").eqNullSafe(F.col("at")) & (F.col("prefix") == F.col("at_prefix"))
        & (F.col("hash") > F.col("low")) & (F.col("size") <= F.col("rest")),
    )
    buckets = inside.groupBy("source", F.shiftright("hash", HASH_BITS - before - bits).alias("bucket")).agg(
        F.sum("size").alias("size"), *[F.first(c).alias(c) for c in ("budget", "low", "rest")]
    )
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    summed = buckets.withColumn("upto", F.sum("size").over(running))
    over = summed.filter(F.col("upto") > F.col("budget"))
    return over.groupBy("source").agg(
        F.min("bucket").alias("prefix"), F.min_by(F.col("budget") - (F.col("upto") - F.col("size")), "bucket").alias("budget"),
        F.first("low").alias("low"), F.first("rest").alias("rest"),
    )


def _taken(limits: str = "limits") -> Column:
    return F.exists(limits, lambda x: (F.col("hash") > x["low"]) & (F.col("hash") <= x["high"]) & (F.col("size") <= x["most"]))


def _thresholds(numbers: DataFrame, budgets: DataFrame, hint) -> DataFrame:
    """(source, limits): the hashes above `low` up to `high` are taken, of documents up to the size `most`."""
    budgets = budgets.filter("budget > 0").select("source", "budget")
    now, rounds = budgets.select("source", F.lit(-1).cast("long").alias("low"), F.col("budget").alias("rest")), []
    for _ in range(ROUNDS):
        at = now.select("source", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("budget"), "low", "rest")
        for level in range(len(LEVEL_BITS)):
            at = _refine(numbers, hint(at), level)
        found = at.select(F.col("source").alias("at"), "prefix", F.col("budget").alias("short"))
        met = now.join(hint(found), F.col("source").eqNullSafe(F.col("at")), "left")
        # without a threshold all that is left fits
        high = F.when(F.col("prefix").isNull(), END).otherwise(F.col("prefix") - 1)
        told = stage(met.select("source", "low", high.alias("high"), F.col("rest").alias("most"), F.col("prefix").alias("next"), "short"), "mix-thresholds")
        rounds.append(told.select("source", F.struct("low", "high", "most").alias("limit")))
        now = told.filter("short > 0").select("source", F.col("next").alias("low"), F.col("short").alias("rest"))
        if now.isEmpty():
            break
    passed = stage(reduce(DataFrame.unionAll, rounds).groupBy("source").agg(F.collect_list("limit").alias("limits")), "mix-limits")
    same = F.col("source").eqNullSafe(F.col("at"))
    told = numbers.join(hint(passed.withColumnRenamed("source", "at")), same)
    used = told.filter(_taken()).groupBy(F.col("at")).agg(F.sum("size").alias("used"))
    rest = budgets.join(hint(used), same, "left").select(
        F.col("source").alias("of"), (F.col("budget") - F.coalesce("used", F.lit(0))).alias("rest")
    )
    gap = lambda c: F.abs(F.col(c) - F.col("rest"))
    one = told.filter(~_taken()).join(hint(rest), F.col("source").eqNullSafe(F.col("of"))).filter(gap("size") < F.col("rest"))
    pick = stage(one.groupBy("at").agg(F.min(F.struct(gap("size").alias("gap"), "hash")).alias("p"), F.first("rest").alias("rest")), "mix-last")
    pick = pick.select("at", "rest", F.col("p.hash").alias("last"))
    # its copies come with it
    copies = numbers.join(hint(pick), same & (F.col("hash") == F.col("last"))).groupBy("at").agg(
        F.sum("size").alias("size"), F.first("rest").alias("rest"), F.first("last").alias("last")
    )
    last = copies.filter(gap("size") < F.col("rest")).select(
        F.col("at").alias("source"), F.struct((F.col("last") - 1).alias("low"), F.col("last").alias("high"), F.lit(END).alias("most")).alias("limit")
    )
    every = passed.select("source", F.explode("limits").alias("limit")).unionAll(last)
    return every.groupBy("source").agg(F.collect_list("limit").alias("limits"))


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most_repeats: int = 3,
    keep_columns: bool = False,
) -> DataFrame:
    """(id, size, source_size, target, repeats, taken), with keep_columns after the columns of docs.

    repeats: how often the mix holds the document; taken: size * repeats.
    """
    names = columns_clear_of(docs, "size", "source_size", "target", "repeats", "taken") if keep_columns else {}
    kept = [F.col(f"`{c}`") for c in (docs.columns if keep_columns else [id_column])]
    sized = docs.select(
        F.struct(*kept).alias("row"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"),
        hash_bits(id_column, text_column).alias("hash"),
    )
    # what the histograms need is written; the texts are neither written nor shuffled, their hashes are made again at the end
    narrow = stage(sized if not keep_columns else sized.drop("row"), "mix")
    numbers = narrow.select("source", "size", "hash")
    plan = stage(targets(numbers.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_repeats), "mix-targets")
    repeats = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budgets = plan.withColumn("full", repeats.cast("long")).withColumn(
        "budget", F.floor(F.col("target") - F.col("full") * F.col("source_size")).cast("long")
    )
    small = F.broadcast if broadcast_if_small(plan) is not plan else (lambda df: df)  # one row per source
    limits = budgets.join(
        _thresholds(numbers, budgets, small).withColumnRenamed("source", "at"), F.col("source").eqNullSafe(F.col("at")), "left"
    ).select(F.col("source").alias("at"), "source_size", "target", "full", "limits")
    limits = stage(limits, "mix-limits")
    extra = F.when(_taken(), 1).otherwise(0)
    mixed = (sized if keep_columns else narrow).join(small(limits), F.col("source").eqNullSafe(F.col("at"))).withColumn(
        "repeats", F.least(F.col("full") + extra, F.lit(most_repeats)).cast("long")
    )
    return mixed.select(
        "row.*",
        *[
            F.expr(e).alias(names.get(n, n))
            for n, e in (
                ("size", "size"), ("source_size", "source_size"), ("target", "target"), ("repeats", "repeats"),
                ("taken", "size * repeats"),
            )
        ],
    )
