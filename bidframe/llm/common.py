"""Helpers the operators share: reading, cutting lineage, numbering, components of a graph."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: A word of the contracts: a run of anything but blanks and the controls 09 to 0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, named in spark.checkpoint.dir; a local one if unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bidframe-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: no lineage, and later column pruning."""
    path = f"{shared_dir(df.sparkSession)}/bidframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, so that work arrays stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def shares(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number rows from 0 in ``order`` without one task holding them all.

    Rows are range partitioned and sorted, written, and numbered from the counts of the
    parts; the counts are one number for each partition.
    """
    part, row = free_name(df, "_part"), free_name(df, "_row")
    place = F.monotonically_increasing_id()
    sorted_ = cut(df.orderBy(*order).withColumn(row, place)
                  .withColumn(part, F.shiftright(F.col(row), 33)))
    counts = sorted(sorted_.groupBy(part).count().collect())
    starts, total = [], 0
    for key, n in counts:
        starts += [F.lit(key), F.lit(total)]
        total += n
    if not starts:
        return sorted_.withColumn(name, F.lit(0).cast("bigint")).drop(part, row)
    inside = F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.withColumn(name, F.create_map(*starts)[F.col(part)] + inside).drop(part, row)


def forest(edges: DataFrame) -> DataFrame:
    """Drop edges (``u``, ``v``) that close a circle within one Arrow batch; reach stays the same."""

    def reduce(batches):
        for batch in batches:
            u, v = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
            root = group(len(nodes), ends[: len(u)], ends[len(u):])
            away = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[root[away]]), pa.array(nodes[away])], ["u", "v"])

    return edges.mapInArrow(reduce, "u bigint, v bigint")


def group(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest node that the links ``a``-``b`` reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, root):
            return root
        root = new


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every end of ``edges`` (``u``, ``v``, long).

    The component is the smallest node in reach. Alternates large-star and small-star
    steps: every node hands its neighbours to its smallest neighbour, until only stars
    are left. Each round is written to the shared folder; only a count and a checksum
    come to the driver. Null ends and loops are dropped.
    """
    pairs = edges.where("u is not null and v is not null and u <> v")
    now = cut(forest(pairs.select(F.col("u").cast("bigint"), F.col("v").cast("bigint")))
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    print_ = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    seen = print_(now)
    while seen[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                 .select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
                                           F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where("u <> v").distinct())
        now = cut(small)
        before, seen = seen, print_(now)
        if seen == before:
            break
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def lowered_words(text: str | None) -> list[bytes]:
    """Words of a text as bytes, A-Z in lower case; the byte split knows just the same blanks."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def texts(batch: pa.RecordBatch, column: int = 0) -> Iterator[str]:
    """Text values one by one, null as empty, so that no second copy of the batch is kept."""
    for value in batch.column(column):
        yield value.as_py() or ""


def rows_of(columns: dict[str, tuple[pa.DataType, list]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for t, v in columns.values()], list(columns))


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def window_sum(keys: list[str], order: list[str | Column], value: str) -> Column:
    """Sum of ``value`` over the earlier rows of the group."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(before), F.lit(0))
