"""Splitting of hot groups.

A request, an item or a supplier may hold a third of all rows. ``find_hot`` counts the
rows per key once (a map-side combined aggregate over the key columns alone) and brings
back at most ``hot_limit`` keys; a longer list stays a table on the cluster and is joined.
With none found, every helper here gives the plain plan.
Otherwise the rows of the listed groups get a salt and the rest keep salt 0, so results
are whole and exact either way.
"""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row, Window, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from bidframe.config import SkewPolicy
from bidframe.sources.staging import staged

WAYS, SALT = "_ways", "_salt"


@dataclass(frozen=True)
class HotGroups:
    """The keys of the oversized groups and the number of parts for each."""

    keys: tuple[str, ...]
    policy: SkewPolicy = SkewPolicy()
    rows: tuple[Row, ...] = field(default=(), repr=False)
    schema: StructType | None = None
    table: DataFrame | None = field(default=None, repr=False, compare=False)

    def frame(self, df: DataFrame) -> DataFrame:
        """Table of the hot keys: broadcast up to ``hot_limit``, else a plain join side."""
        if self.table is not None:
            return self.table
        return F.broadcast(df.sparkSession.createDataFrame(list(self.rows), self.schema))


def find_hot(df: DataFrame, keys: list[str], policy: SkewPolicy = SkewPolicy(),
             rows: Column | None = None) -> HotGroups:
    """List the groups of ``df`` above ``hot_rows`` rows (or above the given sum)."""
    size = F.count(F.lit(1)) if rows is None else F.sum(rows)
    ways = F.ceil(F.col("_n") / policy.hot_rows).cast("int")
    found = (df.groupBy(*keys).agg(size.alias("_n")).where(F.col("_n") > policy.hot_rows)
             .select(*keys, ways.alias(WAYS)))
    first = found.limit(policy.hot_limit + 1).collect()
    schema = StructType([StructField(f.name, f.dataType) for f in found.schema[:-1]]
                        + [StructField(WAYS, IntegerType())])
    table = found if len(first) > policy.hot_limit else None
    return HotGroups(tuple(keys), policy, tuple(first), schema, table)


def spread_rows(df: DataFrame, hot: HotGroups, by: list[str]) -> DataFrame:
    """Add the salt to the many-rows side; ``by`` tells the rows of a group apart."""
    if not hot.rows:
        return df
    part = F.pmod(F.xxhash64(*by), F.col(WAYS).cast("bigint"))
    return (df.join(hot.frame(df), list(hot.keys), "left")
            .withColumn(SALT, F.coalesce(part, F.lit(0)).cast("int")))


def copy_rows(df: DataFrame, hot: HotGroups) -> DataFrame:
    """Repeat the few-rows side once per salt of its group."""
    if not hot.rows:
        return df
    salts = F.sequence(F.lit(0), F.coalesce(F.col(WAYS), F.lit(1)) - 1)
    return (df.join(hot.frame(df), list(hot.keys), "left")
            .withColumn(SALT, F.explode(salts)).drop(WAYS))


def salted(hot: HotGroups, keys: list[str] | None = None) -> list[str]:
    """Key columns to join or partition by after spreading."""
    return [*(keys or hot.keys), SALT] if hot.rows else list(keys or hot.keys)


def spread_join(big: DataFrame, small: DataFrame, hot: HotGroups, by: list[str],
                how: str = "left") -> DataFrame:
    """Join a large table to one with few rows per key, hot keys split over tasks."""
    left = spread_rows(big, hot, by).drop(WAYS)
    return left.join(copy_rows(small, hot), salted(hot), how).drop(SALT)


def group_extremes(df: DataFrame, hot: HotGroups, stats: dict[str, Column]) -> DataFrame:
    """Add per-group min/max aggregates to every row of a spread frame.

    Ordinary groups use a window; hot ones are pre-aggregated and broadcast back.
    """
    window = Window.partitionBy(*salted(hot))
    if not hot.rows:
        return df.withColumns({name: agg.over(window) for name, agg in stats.items()})
    totals = (df.where(F.col(WAYS).isNotNull()).groupBy(*hot.keys)
              .agg(*[agg.alias(f"_hot_{name}") for name, agg in stats.items()]))
    out = df.join(F.broadcast(totals), list(hot.keys), "left")
    for name, agg in stats.items():
        out = out.withColumn(name, F.when(F.col(WAYS).isNull(), agg.over(window))
                             .otherwise(F.col(f"_hot_{name}")))
    return out.drop(*[f"_hot_{name}" for name in stats])


def number_rows(df: DataFrame, hot: HotGroups, order: list[Column], name: str) -> DataFrame:
    """``row_number`` within groups that also holds for groups too big for one task.

    The rows of hot groups are range partitioned and sorted together; a row's number is its place in
    its part, shifted by the rows of its group in earlier parts. The table of those shifts has a row for
    each part that a group reaches into. ``order`` must tell all rows of a group apart.
    """
    keys = list(hot.keys)
    if not hot.rows:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumn(name, F.row_number().over(window).cast("bigint"))
    tagged = df.join(hot.frame(df), keys, "left")
    window = Window.partitionBy(*keys).orderBy(*order)
    few = tagged.where(F.col(WAYS).isNull()).withColumn(name, F.row_number().over(window).cast("bigint"))
    # Rows are sorted over all parts and written; their places then stay as they are.
    many = staged(tagged.where(F.col(WAYS).isNotNull()).orderBy(*[F.col(k) for k in keys], *order)
                  .withColumn("_place", F.monotonically_increasing_id())
                  .withColumn("_part", F.shiftright("_place", 33)))
    sizes = many.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) + 1
                                           - F.col("_first")).alias("_shift"))
    numbered = many.join(starts, [*keys, "_part"]).withColumn(name, F.col("_place") + F.col("_shift"))
    return few.unionByName(numbered.drop("_place", "_part", "_shift")).drop(WAYS)
