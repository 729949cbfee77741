"""Exact deduplication by a stream with keyed state on disk, confirmed byte by byte."""
from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from bidframe.llm.common import cut, shared_dir, shares

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Settings of the state: on disk under a bound of memory, its changes logged at every commit.
STATE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    # Stores close as they commit: each open one holds 4 MB of local disk at least.
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
#: Bits of the filter of repeated digests; a fuller filter costs work, not results.
FILTER_BITS = 1 << 24


def normalised(text: Column) -> Column:
    """Null as empty, A-Z in lower case and nothing else changed."""
    text = F.coalesce(text, F.lit(""))
    # Texts of one byte a character have no other letters, and their lower case is faster.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, wanted: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def _exactly(path: str) -> str:
    """A pattern that only ``path`` fits; as such a stream may read a single file, too."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def _rows(reader, schema: T.StructType, path: str, id_col: str, text_col: str,
          digest: Callable[[Column], Column]) -> DataFrame:
    """``id``, ``file``, ``row``, ``text`` (normalised) and ``digest`` of the rows below ``path``."""
    fields = T.StructType([schema[id_col], schema[text_col]])
    df = reader.schema(fields).parquet(_exactly(path))
    at = df.metadataColumn("_metadata")
    return (df.select(F.col(id_col).alias("id"), at["file_path"].alias("file"), at["row_index"].alias("row"),
                      normalised(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text"))))


def absorb(spark: SparkSession, path: str, state: str, id_col: str = "doc_id", text_col: str = "text",
           digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1_000) -> None:
    """Stream the Parquet files below ``path`` that the state has not seen yet into the state folder.

    The state keeps for each digest, without expiry, the largest id with the file and row that
    hold it, and the number of rows. A run that broke off goes on from its last commit.
    """
    with _settings(spark, STATE):
        source = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        rows = _rows(source, spark.read.parquet(path).schema, path, id_col, text_col, digest)
        keyed = rows.groupBy("digest").agg(F.max(F.struct("id", "file", "row")), F.count(F.lit(1)))
        query = (keyed.writeStream.format("noop").outputMode("update").option("checkpointLocation", state)
                 .trigger(availableNow=True).start())
    query.awaitTermination()


def retained(spark: SparkSession, state: str) -> DataFrame:
    """The state as a table: ``digest``, ``kept`` (id, file, row) and ``n`` rows."""
    found = spark.read.format("statestore").load(state)
    return found.select("key.digest", F.col("value.max").alias("kept"), F.col("value.count").alias("n"))


def _bit(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS))


def _likely(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """``rows`` with ``likely``: whether the filter of the repeated digests lets them through.

    The filter is a table of FILTER_BITS bits at most, so it may be broadcast.
    """
    bit = _bit(F.col("digest"))
    bits = (hits.select(F.shiftright(bit, 15).alias("bucket"), bit.bitwiseAND(F.lit(32767)).alias("at"))
            .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")))
    # Bit number at % 8 of byte at / 8.
    at = bit.bitwiseAND(F.lit(32767)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]),
                                        at.bitwiseAND(F.lit(7)) + 1)) != 0
    return (rows.withColumn("bucket", F.shiftright(bit, 15)).join(F.broadcast(bits), "bucket", "left")
            .withColumn("likely", F.coalesce(held, F.lit(False))).drop("bucket", "bits"))


def checked(spark: SparkSession, path: str, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Every row below ``path`` with what the state holds for its digest (``kept``, ``n``).

    Where that is another row too, both normalised texts are compared; ``other`` holds the
    text of a row that differs from the kept one of its digest, else null. Digests with very
    many rows are split into salted parts, each of which gets the kept text.
    """
    rows = _likely(_rows(spark.read, spark.read.parquet(path).schema, path, id_col, text_col, digest),
                   kept.where("n > 1"))
    ways = shares(spark)
    texts = (rows.where("likely").select("file", "row", F.col("text").alias("kept_text"))
             .join(kept.where("n > 1").select("digest", F.col("kept.file"), F.col("kept.row")), ["file", "row"])
             .select("digest", "kept_text"))
    limit = (kept.agg(F.sum("n")).first()[0] or 0) // (4 * ways) + 1
    # At most 4 * ways digests have more than the limit.
    hot = F.broadcast(kept.where(F.col("n") > limit).select("digest", F.lit(ways).alias("ways")))
    salt = F.pmod(F.xxhash64("file", "row"), F.coalesce("ways", F.lit(1))).cast("int")
    left = (rows.join(hot, "digest", "left").withColumn("salt", salt)
            .withColumn("sha256", F.sha2("text", 256)).withColumn("text", F.when(F.col("likely"), F.col("text")))
            .withColumn("salts", F.coalesce("ways", F.lit(1))).drop("ways", "likely"))
    right = _copies(kept.join(texts, "digest", "left").withColumn(
        "salts", F.when(F.col("n") > limit, ways).otherwise(1))).drop("salts")
    differs = (F.col("n") > 1) & ~F.col("text").eqNullSafe(F.col("kept_text"))
    return (left.join(right, ["digest", "salt"])
            .select("id", "file", "row", "sha256", "digest", "salt", "salts", "kept", "n",
                    F.when(differs, F.col("text")).alias("other")))


def _copies(df: DataFrame) -> DataFrame:
    """A row for each of its ``salts``."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))


def duplicates(spark: SparkSession, path: str, state: str | None = None, id_col: str = "doc_id",
               text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """For every row of the Parquet table at ``path`` the row that stays of its equal texts.

    Texts are equal when the same bytes after lower-casing A-Z; null counts as empty. Of equal
    texts the row of the largest id stays (null below any), of equal ids the one in the last
    file and row; it has ``kept``. ``group_size`` counts rows, so repeated rows count each.
    Columns: the id, keep_id, group_size, kept, text_sha256. An empty table gives no rows. Only
    the id, of any sortable type, and the text are read, so further columns may have any name.

    ``state`` is the folder of the state, in shared storage; rows absorbed before count too.
    A digest only proposes: a row whose text is not that of the kept row forms a group of its
    own with those it does equal.
    """
    state = state or f"{shared_dir(spark)}/bidframe-{uuid.uuid4().hex}"
    absorb(spark, path, state, id_col, text_col, digest)
    kept = cut(retained(spark, state))
    rows = cut(checked(spark, path, kept, id_col, text_col, digest))
    apart = rows.where("other IS NOT NULL")
    own = _copies(apart.groupBy("digest", "salts", "other").agg(
        F.max(F.struct("id", "file", "row")).alias("own_kept"), F.count(F.lit(1)).alias("own_n"))).drop("salts")
    fewer = _copies(apart.groupBy("digest", "salts").agg(F.count(F.lit(1)).alias("less"))).drop("salts")
    keep = F.coalesce("own_kept", "kept")
    size = F.coalesce(F.col("own_n"), F.col("n") - F.coalesce("less", F.lit(0)))
    return (rows.join(own, ["digest", "salt", "other"], "left").join(fewer, ["digest", "salt"], "left")
            .select(F.col("id").alias(id_col), keep["id"].alias("keep_id"), size.cast("bigint").alias("group_size"),
                    ((keep["file"] == F.col("file")) & (keep["row"] == F.col("row"))).alias("kept"),
                    F.col("sha256").alias("text_sha256")))
