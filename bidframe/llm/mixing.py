"""Mixing sources to target weights by capped water-filling."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from bidframe.llm.common import WORD, cut, free_name, shares, window_sum

#: Rows that one task numbers within a source; sets the number of hash buckets.
BUCKET_ROWS = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def water_fill(sources: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """Add ``target`` to (``source``, ``source_size``, ``weight``).

    Every source gets its share by weight of ``budget`` words. Those above
    ``max_epochs`` times their size are clamped there and the rest is shared again,
    until none is above. Each round is one small aggregate; at least one source is
    clamped in each, usually many. Sources with null or no positive weight get 0.
    """
    cap = F.col("source_size") * max_epochs
    weight = F.coalesce(F.greatest("weight", F.lit(0)), F.lit(0))
    level = None
    while True:
        # Above the level of the last round means clamped; the level only rises.
        clamped = F.lit(False) if level is None else F.col("weight") * level >= cap
        used, left, full = sources.agg(F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, weight)),
                                       F.sum(F.when(clamped, 1))).first()
        # The target of a free source; integers until the one division, so that engines agree.
        rest = budget - int(used or 0)
        if not left:
            break
        new = rest / float(left)
        if level is not None and new <= level:
            break
        level = new
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    share = F.col("weight").cast("double") * F.lit(level)
    return sources.withColumn("target", F.when(weight > 0, F.least(share, cap.cast("double"))).otherwise(0.0))


def mix(docs: DataFrame, weights: DataFrame, budget_share: float = 1.0, max_epochs: int = 3,
        seed: str = "mix", id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """(``doc_id``, ``size``, ``source``, ``source_size``, ``target``, ``taken``), a row for each of ``docs``.

    ``weights`` has (``source``, ``weight``); sources compare null-safe and one without
    weight gets target 0. Each source is repeated whole ``floor(target / size)`` times; for
    the rest its documents are put in a seeded hash order and taken until the target is
    reached, the last one in part, so a source's words equal its target rounded down.

    The order is kept without sorting a source in one task: rows go to buckets by the
    leading digits of their hash, the sizes are summed by bucket, and only within a bucket
    rows are numbered. Null texts and texts without words have size 0 and take 0; rows that
    share an id are separate documents with equal place in the order; extra columns are
    not read. An empty table gives an empty result.
    """
    sized = cut(docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("size"),
                            F.col(source_col).alias("source"))
                .withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))))
    rows, total = sized.agg(F.count("*"), F.sum("size")).first()
    grouped = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weighed = cut(grouped.join(weights.select(F.col("source").alias("_s"), "weight"),
                               F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))
    targets = water_fill(weighed, int((total or 0) * budget_share), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("bigint")).withColumn(
        "part", F.floor("target") - F.col("whole") * F.col("source_size"))

    # A power of 16, so that it is a number of leading hash digits.
    digits = 1
    while digits < 8 and 16 ** digits * BUCKET_ROWS < rows:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    starts = sums.withColumn("start", window_sum(["source"], ["bucket"], "words")).drop("words")
    plan = starts.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = plan.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "start", "source_size",
                       "target", "whole", "part")
    placed = sized.withColumn("before", window_sum(["source", "bucket"], ["key", "doc_id", "size"], "size"))
    joined = placed.join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    at = F.col("start") + F.col("before")
    more = F.greatest(F.lit(0), F.least("size", F.col("part") - at))
    return joined.select("doc_id", "size", "source", "source_size", "target",
                         (F.col("whole") * F.col("size") + more).cast("bigint").alias("taken"))


def cycle_weights(docs: DataFrame, cycle: tuple[int, ...] = (5, 2, 1), source_col: str = "source") -> DataFrame:
    """(``source``, ``weight``): weights dealt in turn to the sources by code point, null last."""
    from bidframe.llm.common import numbered

    names = docs.select(F.col(source_col).alias("source")).distinct()
    order = numbered(names, [F.col("source").asc_nulls_last()], "_n")
    picked = F.array(*[F.lit(w) for w in cycle])[F.pmod("_n", F.lit(len(cycle))).cast("int")]
    return order.select("source", picked.cast("bigint").alias("weight"))


def repeat(docs: DataFrame, weights: DataFrame, max_epochs: int = 3, seed: str = "mix",
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: ``docs`` with a row for each repetition, numbered in ``repetition``.

    A repetition in part holds the first words of its text, joined by blanks; documents
    the mix doesn't take go. Rows that share an id, size and source share one decision.
    """
    plan = mix(docs, weights, 1.0, max_epochs, seed, id_col, text_col, source_col)
    plan = (plan.groupBy("doc_id", "size", "source").agg(F.max("taken").alias("taken"))
            .where("taken > 0").select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "size", "source", "taken")]))
    names = docs.columns
    size, number = free_name(docs, "_words"), free_name(docs, "repetition")
    on = (F.col(id_col).eqNullSafe(F.col("_doc_id")) & (F.col(size) == F.col("_size"))
          & F.col(source_col).eqNullSafe(F.col("_source")))
    taken = docs.withColumn(size, words(F.col(text_col))).join(plan, on)
    each = taken.withColumn(number, F.explode(F.sequence(
        F.lit(1), F.ceil(F.col("_taken") / F.col("_size")).cast("int"))))
    kept = (F.col("_taken") - (F.col(number) - 1) * F.col("_size")).cast("int")
    first = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(f"({WORD})")), 1, kept), " ")
    part = kept < F.col(size)
    out = each.withColumn(text_col, F.when(part, first).otherwise(F.col(text_col)))
    return out.select(*names, number)
