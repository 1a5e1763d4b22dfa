"""Shared pieces of the training-data operators: work tables in the shared folder and the text conventions of the contracts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Broadcast only tables measured to be at most this large.
BROADCAST_BYTES = 64 << 20
_made: list[str] = []  # folders of work tables


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; only where that is unset (tests, local mode), one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: work tables need a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    folder = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    _made.append(folder)
    atexit.register(remove, spark, folder)
    return f"{folder}/{name}"


@contextlib.contextmanager
def scratch(spark: SparkSession, spare: Callable[[], list[str]] = list):
    """Remove the work tables made inside, when it ends well, but for the paths that spare() gives by then: what comes out
    must be written."""
    start = len(_made)
    yield
    paths = {path.rsplit("/", 1)[0] for path in spare()}
    for folder in _made[start:]:
        if folder not in paths:
            remove(spark, folder)
    _made[start:] = [folder for folder in _made[start:] if folder in paths]


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may have ended before the clean-up
        pass


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs a reread."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(col: Column) -> Column:
    """A-Z only; pure ASCII takes the fast built-in, anything else a table, so that other scripts stay as they are."""
    return F.when(F.octet_length(col) == F.char_length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def word_count(col: Column) -> Column:
    """Words of a text: starts of runs of non-space; null has none."""
    cut = F.split(F.coalesce(col, F.lit("")), SPACE_CLASS)
    edge = lambda at: (F.element_at(cut, at) == "").cast("int")
    n = F.size(cut)
    return F.when(n == 1, 1 - edge(1)).otherwise(n - edge(1) - edge(-1)).cast("long")


def slices(batches, rows: int = 1000):
    """Arrow batches in pieces of so many rows at most, so that a Python worker holds the objects of one piece."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
            give_back()


def give_back() -> None:
    """Return freed memory to the system, as idle Python workers stay beside the executor."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts are long rows: Arrow batches of the default 10,000 of them are large off the heap and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))
