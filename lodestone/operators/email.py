"""E-mail rows and their attachments: projection, names, deduplication, statistics, composite reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import attachment_name, empty_to_null, extension, mime_type, ole_magic, safe_filename

EMAIL_FIELDS = ("filename", "subject", "body", "sender", "to", "cc", "bcc", "message_id", "importance")
# Which attachments are read how, and the name of a message without one.
ROUTES = {"pdf": (".pdf",), "image": (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif"), "text": (".txt", ".rtf")}
UNKNOWN = "unknown.msg"


def is_msg(path: Column) -> Column:
    return F.coalesce(F.lower(path).endswith(".msg"), F.lit(False))


def messages(files: DataFrame) -> DataFrame:
    """files: path, content. With filename (a default if empty) and, for what is no message, an error."""
    name = F.regexp_extract(F.coalesce("path", F.lit("")), r"([^/\\]*)$", 1)
    named = F.when(name == "", UNKNOWN).otherwise(name)
    error = F.when(~is_msg(named), "not a .msg name").when(~ole_magic(F.col("content")), "not an OLE file")
    return files.withColumn("filename", named).withColumn("error", error)


def metadata(emails: DataFrame) -> DataFrame:
    """email_id and the ten fields, empty ones null, the date as text."""
    have = [empty_to_null(F.col(c)).alias(c) if c in emails.columns else F.lit(None).cast("string").alias(c) for c in EMAIL_FIELDS]
    return emails.select("email_id", *have, F.col("date").cast("string").alias("date") if "date" in emails.columns else F.lit(None).cast("string").alias("date"))


def attachments(emails: DataFrame, column: str = "attachments") -> DataFrame:
    """A row per attachment: email_id, pos, filename (safe), size, content_type, is_embedded_email.

    The column holds structs (long_name, short_name, display_name, size, is_embedded_email)."""
    a = F.col("a")
    name = safe_filename(attachment_name(a["long_name"], a["short_name"], a["display_name"], F.col("pos")))
    return emails.select("email_id", F.posexplode(column).alias("pos", "a")).select("email_id", "pos", name.alias("filename"), a["size"].alias("size"), mime_type(name).alias("content_type"), F.coalesce(a["is_embedded_email"], F.lit(False)).alias("is_embedded_email"))


def first_of_each(rows: DataFrame) -> DataFrame:
    """Of attachments of one e-mail with equal name and size, the first."""
    nth = F.row_number().over(Window.partitionBy("email_id", "filename", "size").orderBy("pos"))
    return rows.withColumn("_n", nth).filter("_n = 1").drop("_n")


def free_names(names: list[str]) -> list[str]:
    """Each name, or the first of stem_1.ext, stem_2.ext, ... that no earlier one has taken."""
    taken: set[str] = set()
    tried: dict[str, int] = {}
    out = []
    for name in names:
        free = name
        stem, dot, end = name.rpartition(".")
        stem, end = (stem, dot + end) if dot else (name, "")
        while free in taken:
            tried[name] = tried.get(name, 0) + 1
            free = f"{stem}_{tried[name]}{end}"
        taken.add(free)
        out.append(free)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def free_names_of(lists: pd.Series) -> pd.Series:
    return lists.map(lambda names: free_names(list(names)))


def unique_names(rows: DataFrame) -> DataFrame:
    """rows: email_id, pos, filename and others. With path: names that an earlier attachment of the e-mail has, given or
    found, get _1, _2, ... before the extension until they are free. An e-mail's attachments are one list."""
    others = [c for c in rows.columns if c != "email_id"]
    lists = rows.groupBy("email_id").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in others if c != "pos"]))).alias("a"))
    named = lists.withColumn("paths", free_names_of(F.transform("a", lambda x: x["filename"])))
    return named.select("email_id", F.inline(F.arrays_zip("a", "paths"))).select("email_id", *[F.col("a")[c].alias(c) for c in others], F.col("paths").alias("path")).select(*rows.columns, "path")


def stats(rows: DataFrame) -> DataFrame:
    """email_id, total, embedded, total_bytes, total_mb, by_type; embedded e-mails are counted apart."""
    own = ~F.col("is_embedded_email")
    by_type = rows.filter(own).groupBy("email_id", "content_type").agg(F.count(F.lit(1)).alias("n"))
    types = by_type.groupBy("email_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("content_type", "n")))).alias("by_type"))
    size = F.sum(F.when(own, F.coalesce("size", F.lit(0))).otherwise(0))
    total = rows.groupBy("email_id").agg(F.count_if(own).alias("total"), F.count_if(~own).alias("embedded"), size.alias("total_bytes"), F.round(size / 1048576, 2).alias("total_mb"))
    return total.join(types, "email_id", "left")


def route(name: Column) -> Column:
    """How an attachment is read: pdf, image, text or none."""
    end = extension(name)
    out = F.lit("none")
    for kind, ends in ROUTES.items():
        out = F.when(end.isin(*ends), kind).otherwise(out)
    return out


def consolidate(bodies: DataFrame, texts: DataFrame) -> DataFrame:
    """bodies: email_id, text; texts: email_id, pos, filename, text. email_id, text: the body, then each text under a header."""
    head = texts.select("email_id", "pos", F.concat(F.lit("\n--- FROM "), "filename", F.lit(" ---\n"), F.coalesce("text", F.lit(""))).alias("t"))
    rows = bodies.select("email_id", F.lit(-1).alias("pos"), F.coalesce("text", F.lit("")).alias("t")).unionByName(head)
    return rows.groupBy("email_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]), "").alias("text"))
