"""Files as tables: binary scans with digests, JSON candidates and queries, sinks.

All paths go through Spark's readers and writers, so any store that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import human_size
from lodestone.operators.ranking import PROVIDER_FIELDS

# Keys under which a JSON document may hold its candidates, in order.
WRAPPERS = ("providers", "data", "candidates")
BUCKETS = 256


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length, content of all files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def pdfs(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, "*.[pP][dD][fF]")


def images(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, "*.{jpg,jpeg,png,bmp,tiff,tif,heif,JPG,JPEG,PNG,BMP,TIFF,TIF,HEIF}")


def emails(spark: SparkSession, path: str) -> DataFrame:
    return files(spark, path, "*.[mM][sS][gG]")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def listing(scanned: DataFrame, root: str) -> DataFrame:
    """path relative to a root, length."""
    return scanned.select(F.regexp_replace("path", "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "").alias("path"), "length")


def described(scanned: DataFrame, trusted: Column | None = None) -> DataFrame:
    """File facts: name, extension, size, human size, digests; matches_trusted_hash is null without a trusted digest."""
    sha = F.sha2("content", 256)
    return scanned.select(
        "path", base_name(F.col("path")).alias("file_name"), F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1)).alias("file_extension"), F.col("length").alias("file_size_bytes"), human_size(F.col("length")).alias("file_size_human"),
        F.col("modificationTime").alias("file_modified"), F.md5("content").alias("md5"), sha.alias("sha256"), (F.lit(None).cast("boolean") if trusted is None else sha == F.lower(trusted)).alias("matches_trusted_hash"), "content",
    )


def verified(facts: DataFrame) -> DataFrame:
    """Unknown counts as not verified."""
    return facts.withColumn("verified", F.coalesce("matches_trusted_hash", F.lit(False)))


def missing(expected: DataFrame, scanned: DataFrame) -> DataFrame:
    """Expected paths (column path) that no file has."""
    return expected.join(scanned.select("path"), "path", "left_anti")


def candidates_json(spark: SparkSession, path: str) -> DataFrame:
    """Candidates from a JSON list, or from an object: the first wrapper that holds a list, else the object is one row."""
    raw = spark.read.option("multiLine", True).json(path)
    for key in WRAPPERS:
        if key in raw.columns and raw.schema[key].dataType.typeName() == "array":
            return raw.select(F.explode(key).alias("c")).select("c.*")
    return raw


def query_json(spark: SparkSession, path: str) -> DataFrame:
    """One query record: known fields only, all of them text and optional."""
    return spark.read.option("multiLine", True).schema(", ".join(f"{f} string" for f in PROVIDER_FIELDS)).json(path)


def write_ranking(response: DataFrame, path: str) -> None:
    """JSON without the candidates' own data."""
    matches = F.transform("matches", lambda m: m.dropFields("candidate_data")) if "candidate_data" in response.schema["matches"].dataType.elementType.names else F.col("matches")
    response.withColumn("matches", matches).write.mode("overwrite").json(path)


def write_report(assessed: DataFrame, path: str, form: str = "json") -> None:
    """Reports as JSON, or as text with a line per indicator."""
    if form not in ("json", "txt"):
        raise ValueError(f"no report format {form!r}")
    if form == "json":
        assessed.write.mode("overwrite").json(path)
    else:
        head = F.concat_ws(" ", F.col("path"), F.lit("risk"), F.col("risk_score").cast("string"), F.col("risk_level"))
        assessed.select(F.concat_ws("\n", head, F.array_join(F.transform("indicators", lambda i: F.concat(F.lit("- "), i)), "\n")).alias("value")).write.mode("overwrite").text(path)


def write_attachments(rows: DataFrame, path: str) -> DataFrame:
    """Payloads (content) as a table in BUCKETS folders by hash of the e-mail, sorted within, so that an e-mail is found by
    its folder and the files' statistics; the rows come back without the bytes, with the folder they are in."""
    bucket = F.pmod(F.xxhash64("email_id"), F.lit(BUCKETS)).cast("int")
    rows.withColumn("bucket", bucket).repartition("bucket").sortWithinPartitions("bucket", "email_id").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return rows.drop("content").withColumn("stored", F.concat(F.lit(f"{path}/bucket="), bucket.cast("string")))
