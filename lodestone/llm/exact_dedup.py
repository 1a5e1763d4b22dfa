"""Exact deduplication as a stream: disk-backed keyed state, never expired, of digest -> (identifier, content locator, count).

Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the largest doc_id stays; of
rows that repeat that doc_id and text, the one with the largest locator. Null doc_ids rank below all others. An empty
table gives an empty result. Extra columns are neither read nor lost; names do not clash, as work columns live in
tables of their own.

Path, all built-in functions: each source file's rows are reduced to (digest, doc_id, locator) in a landing folder; a
structured stream reads the folder (availableNow) into a RocksDB-backed aggregation; the state is read back with the
state data source. The same checkpoint continues with later files. Rows whose digest is shared are compared by their
full bytes; a digest shared by different texts (never seen with SHA-256, tested with shortened digests) is resolved by
grouping its rows by their whole text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from .common import BROADCAST_BYTES, LOWER, UPPER, ascii_lower, keep, read_table, work_path

LANDING = T.StructType([
    T.StructField("digest", T.BinaryType()),
    T.StructField("doc_id", T.LongType()),
    T.StructField("file", T.StringType()),
    T.StructField("row", T.LongType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Without fallocate, an instance takes the disk that its data needs, not 4 MB or more from the start; all instances of an
#: executor share one bound of memory.
STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}


#: Plan nodes over a Parquet scan that neither repeat nor merge rows, so that file and row still name one row.
PLAIN_NODES = {"Relation", "Project", "Filter", "SubqueryAlias", "View"}


def located(docs: DataFrame) -> DataFrame:
    """docs with a stable content locator: file and row of the Parquet it comes from; other inputs are written first."""
    def with_place(df: DataFrame) -> DataFrame:
        return df.select("*", F.col("_metadata.file_path").alias("_ls_file"), F.col("_metadata.row_index").alias("_ls_row"))

    plan = docs._jdf.queryExecution().analyzed().toString().splitlines()
    if {m.group(1) for line in plan if (m := re.match(r"[\s:+|-]*(\w+)", line))} <= PLAIN_NODES:
        try:
            return with_place(docs)
        except AnalysisException:
            pass  # a source without row numbers
    return with_place(keep(docs, "located"))


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def digest_of(text: Column, digest_bytes: int = 32) -> Column:
    return F.substring(F.unhex(F.sha2(normalised(text), 256)), 1, digest_bytes)


def land(placed: DataFrame, landing: str, digest_bytes: int = 32) -> None:
    """Append digests, identifiers and locators of the rows to the landing folder that the stream reads."""
    placed.select(digest_of(F.col("text"), digest_bytes).alias("digest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_ls_file").alias("file"), F.col("_ls_row").alias("row")).write.mode("append").parquet(landing)


def advance(spark: SparkSession, landing: str, checkpoint: str) -> DataFrame:
    """Run the stream over all files not yet seen; return the whole state: digest, keeper struct, group_size."""
    before = {k: spark.conf.get(k, None) for k in STORE_CONF}
    for k, v in STORE_CONF.items():
        spark.conf.set(k, v)
    try:
        grouped = (
            spark.readStream.schema(LANDING).parquet(landing)
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        )
        query = grouped.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        return state.select(F.col("key.digest").alias("digest"), F.col("value.max").alias("keeper"), F.col("value.count").alias("group_size"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def collided(placed: DataFrame, state: DataFrame, digest_bytes: int) -> DataFrame:
    """Full-byte check of all hits: digests under which different texts lie."""
    hits = keep(state.filter("group_size > 1").select("digest"), "hits")
    rows = placed.select(digest_of(F.col("text"), digest_bytes).alias("digest"), normalised(F.col("text")).alias("norm"))
    side = F.broadcast(hits) if hits.count() * 64 <= BROADCAST_BYTES else hits
    return rows.join(side, "digest", "left_semi").groupBy("digest").agg((F.min("norm") != F.max("norm")).alias("mixed")).filter("mixed").select("digest")


def classes(docs: DataFrame, digest_bytes: int = 32, checkpoint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(placed documents, one row per document: doc_id, file, row, digest, keep_id, keep_file, keep_row, group_size)."""
    spark = docs.sparkSession
    placed = located(docs)
    checkpoint = checkpoint or work_path(spark, "state")
    landing = work_path(spark, "landing")
    land(placed, landing, digest_bytes)
    state = keep(advance(spark, landing, checkpoint), "classes")
    seen = spark.read.schema(LANDING).parquet(landing)
    flat = state.select("digest", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.file").alias("keep_file"), F.col("keeper.row").alias("keep_row"), "group_size")
    mixed = keep(collided(placed, state, digest_bytes), "mixed")
    if mixed.isEmpty():
        return placed, seen.join(flat, "digest")
    plain = seen.join(mixed, "digest", "left_anti").join(flat, "digest")
    whole = placed.select(digest_of(F.col("text"), digest_bytes).alias("digest"), normalised(F.col("text")).alias("norm"), F.col("doc_id").cast("long").alias("doc_id"), F.col("_ls_file").alias("file"), F.col("_ls_row").alias("row")).join(mixed, "digest", "left_semi")
    by_text = whole.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "file", "row")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    split = whole.join(by_text, ["digest", "norm"]).select("digest", "doc_id", "file", "row", F.col("keeper.doc_id").alias("keep_id"), F.col("keeper.file").alias("keep_file"), F.col("keeper.row").alias("keep_row"), "group_size")
    return placed, plain.unionByName(split)


def deduplicate(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One document of each class, with all its columns."""
    placed, rows = classes(docs, digest_bytes)
    kept = rows.filter(F.col("file").eqNullSafe(F.col("keep_file")) & F.col("row").eqNullSafe(F.col("keep_row"))).select(F.col("file").alias("_ls_file"), F.col("row").alias("_ls_row"))
    return placed.join(kept, ["_ls_file", "_ls_row"], "left_semi").select(*docs.columns)


def report(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per document, dropped ones too; text_sha256 is of the normalised text."""
    _, rows = classes(docs.select("doc_id", "text"), digest_bytes)
    kept = F.col("file").eqNullSafe(F.col("keep_file")) & F.col("row").eqNullSafe(F.col("keep_row"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
