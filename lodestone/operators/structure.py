"""Nested document-analysis results: flattening, projections, page assembly, tables, deduplication of visuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clamp

REGION = "struct<page_number:int,polygon:array<double>>"
SPANS = "array<struct<offset:int,length:int>>"
CELL = f"struct<content:string,row_index:int,column_index:int,row_span:int,column_span:int,kind:string,bounding_regions:array<{REGION}>,spans:{SPANS}>"
#: Schema of a document-analysis result, for from_json.
RESULT = (
    "struct<pages:array<struct<page_number:int,width:double,height:double,unit:string,angle:double,lines:array<struct<content:string,polygon:array<double>>>,words:array<struct<content:string,confidence:double,polygon:array<double>>>,"
    "selection_marks:array<struct<state:string,confidence:double,polygon:array<double>>>>>,"
    f"tables:array<struct<row_count:int,column_count:int,cells:array<{CELL}>,bounding_regions:array<{REGION}>,spans:{SPANS}>>,"
    "key_value_pairs:array<struct<key:struct<content:string>,value:struct<content:string>>>,figures:array<struct<id:string,caption:string>>,paragraphs:array<struct<content:string,role:string>>>"
)
# Page separator, least characters of a page that counts, limit of images, and what a page says on reaching it.
PAGE_BREAK, LEAST_PAGE, IMAGE_LIMIT = "\n--- PAGE BREAK ---\n", 10, 50
STOPPED = "\n[stopped: image limit reached]\n"


def parse(docs: DataFrame, column: str = "result") -> DataFrame:
    """docs with the JSON column parsed; what is no result has empty lists and an error."""
    parsed = F.from_json(column, RESULT)
    return docs.withColumn("error", F.when(parsed.isNull() | (parsed["pages"].isNull() & parsed["paragraphs"].isNull()), "not a document-analysis result")).withColumn(column, parsed)


def listed(col: Column, kind: str) -> Column:
    return F.coalesce(col, F.array().cast(kind))


def pages(docs: DataFrame, column: str = "result") -> DataFrame:
    """doc_id, page_number, width, height, unit, angle, lines (texts), words (text, confidence), n_marks."""
    p = F.col("p")
    return docs.select("doc_id", F.explode(f"{column}.pages").alias("p")).select(
        "doc_id", p["page_number"].alias("page_number"), F.coalesce(p["width"], F.lit(0.0)).alias("width"), F.coalesce(p["height"], F.lit(0.0)).alias("height"), F.coalesce(p["unit"], F.lit("")).alias("unit"), F.coalesce(p["angle"], F.lit(0.0)).alias("angle"),
        listed(F.transform(p["lines"], lambda x: F.coalesce(x["content"], F.lit(""))), "array<string>").alias("lines"),
        listed(F.transform(p["words"], lambda x: F.struct(F.coalesce(x["content"], F.lit("")).alias("content"), F.coalesce(x["confidence"], F.lit(0.0)).alias("confidence"))), "array<struct<content:string,confidence:double>>").alias("words"),
        F.coalesce(F.size(p["selection_marks"]), F.lit(0)).alias("n_marks"),
    )


def cells(docs: DataFrame, column: str = "result") -> DataFrame:
    """doc_id, table, row_index, column_index, row_span, column_span, kind, content."""
    t = docs.select("doc_id", F.posexplode(f"{column}.tables").alias("table", "t")).select("doc_id", "table", F.explode("t.cells").alias("c"))
    given = lambda field, default: F.coalesce(f"c.{field}", F.lit(default)).alias(field)
    return t.select("doc_id", "table", "c.row_index", "c.column_index", given("row_span", 1), given("column_span", 1), given("kind", "content"), given("content", ""))


def table_rows(cell_rows: DataFrame) -> DataFrame:
    """doc_id, table, rows: array<array<string>> by row and column, for markdown_table."""
    row = cell_rows.groupBy("doc_id", "table", "row_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("column_index", "content"))), lambda c: c["content"]).alias("cells"))
    return row.groupBy("doc_id", "table").agg(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "cells"))), lambda r: r["cells"]).alias("rows"))


def key_values(docs: DataFrame, column: str = "result") -> DataFrame:
    """doc_id, key, value; pairs without a key go."""
    return docs.select("doc_id", F.explode(f"{column}.key_value_pairs").alias("kv")).filter("kv.key.content IS NOT NULL AND kv.key.content <> ''").select("doc_id", F.col("kv.key.content").alias("key"), F.coalesce("kv.value.content", F.lit("")).alias("value"))


def paragraphs(docs: DataFrame, column: str = "result") -> DataFrame:
    return docs.select("doc_id", F.posexplode(f"{column}.paragraphs").alias("at", "p")).select("doc_id", "at", F.coalesce("p.content", F.lit("")).alias("content"), "p.role")


def sample(docs: DataFrame, column: str = "result", lines: int = 5, words: int = 10, chars: int = 100) -> DataFrame:
    """doc_id, counts and samples, as a report shows them."""
    c = F.col(column)
    first = F.try_element_at(c["pages"], F.lit(1))
    return docs.select(
        "doc_id", F.coalesce(F.size(c["pages"]), F.lit(0)).alias("n_pages"), F.coalesce(F.size(c["tables"]), F.lit(0)).alias("n_tables"),
        F.slice(listed(F.transform(first["lines"], lambda x: x["content"]), "array<string>"), 1, lines).alias("lines"), F.slice(listed(F.transform(first["words"], lambda x: x["content"]), "array<string>"), 1, words).alias("words"),
        F.transform(listed(F.transform(c["paragraphs"], lambda p: p["content"]), "array<string>"), lambda x: F.left(x, F.lit(chars))).alias("paragraphs"),
    )


def features(docs: DataFrame, column: str = "result") -> DataFrame:
    """doc_id, text, key_phrases, page_count, has_tables: what the choice of a model needs (doctype.detect)."""
    c = F.col(column)
    text = F.array_join(F.flatten(F.transform(c["pages"], lambda p: F.transform(p["lines"], lambda x: x["content"]))), "\n")
    keys = listed(F.filter(F.transform(c["key_value_pairs"], lambda kv: kv["key"]["content"]), lambda k: k.isNotNull()), "array<string>")
    return docs.select("doc_id", F.coalesce(text, F.lit("")).alias("text"), keys.alias("key_phrases"), F.coalesce(F.size(c["pages"]), F.lit(0)).alias("page_count"), (F.coalesce(F.size(c["tables"]), F.lit(0)) > 0).alias("has_tables"))


def clamp_box(box: Column, width: Column, height: Column) -> Column:
    """struct(x0, top, x1, bottom) within the page."""
    zero = F.lit(0.0)
    return F.struct(clamp(box["x0"], zero, width).alias("x0"), clamp(box["top"], zero, height).alias("top"), clamp(box["x1"], zero, width).alias("x1"), clamp(box["bottom"], zero, height).alias("bottom"))


def bands(page_rows: DataFrame) -> DataFrame:
    """page_rows: doc_id, page, height, tables (array of (top, bottom)). doc_id, page, band, top, bottom, is_table.

    From the top: text above each table (if there is any), then the table; then the rest. Overlapping tables stay as they are."""
    t = page_rows.select("doc_id", "page", "height", F.posexplode_outer(F.array_sort("tables")).alias("i", "t"))
    order = Window.partitionBy("doc_id", "page").orderBy("i")
    above = F.coalesce(F.max("t.bottom").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    last = F.lead("i").over(order).isNull()
    text = F.when(F.col("t").isNotNull() & (F.col("t.top") > F.col("above")), F.struct(F.col("above").alias("top"), F.col("t.top").alias("bottom"), F.lit(False).alias("is_table")))
    table = F.when(F.col("t").isNotNull(), F.struct(F.col("t.top").alias("top"), F.col("t.bottom").alias("bottom"), F.lit(True).alias("is_table")))
    end = F.when(F.col("t").isNull(), F.lit(0.0)).otherwise(F.greatest("above", "t.bottom"))
    rest = F.when(F.col("last") & (end < F.col("height")), F.struct(end.alias("top"), F.col("height").alias("bottom"), F.lit(False).alias("is_table")))
    made = t.withColumn("above", above).withColumn("last", last).select("doc_id", "page", F.coalesce("i", F.lit(0)).alias("i"), F.posexplode(F.array_compact(F.array(text, table, rest))).alias("j", "b"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("i", "j")) - 1
    return made.select("doc_id", "page", nth.alias("band"), "b.top", "b.bottom", "b.is_table")


def page_text(band_rows: DataFrame) -> DataFrame:
    """band_rows: doc_id, page, band, is_table, markdown, text. doc_id, page, text: a table gives its Markdown and then its raw text."""
    piece = F.concat(F.when(F.col("is_table"), F.concat(F.coalesce("markdown", F.lit("")), F.lit("\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    return band_rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("band", piece.alias("t")))), lambda x: x["t"]), "\n").alias("text"))


def assemble(page_rows: DataFrame, image_limit: int = IMAGE_LIMIT) -> DataFrame:
    """page_rows: doc_id, page, text, n_images. doc_id, text: pages in order, each long enough one followed by a break;
    pages stop once the images so far reach the limit, and the text says so."""
    so_far = F.sum(F.coalesce("n_images", F.lit(0))).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1))
    kept = page_rows.withColumn("so_far", F.coalesce(so_far, F.lit(0))).filter(F.col("so_far") < image_limit)
    body = F.when(F.char_length("text") > LEAST_PAGE, F.concat("text", F.lit(PAGE_BREAK))).otherwise("")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", body.alias("t")))), lambda x: x["t"]), "")
    return kept.groupBy("doc_id").agg(joined.alias("body"), F.sum(F.coalesce("n_images", F.lit(0))).alias("n")).select("doc_id", F.concat("body", F.when(F.col("n") >= image_limit, STOPPED).otherwise("")).alias("text"))


def first_of_content(visuals: DataFrame, content: str = "content") -> DataFrame:
    """visuals: doc_id, page, pos, content (bytes or text). Without later ones of equal SHA-256 in a document; sha256 added."""
    hashed = visuals.withColumn("sha256", F.sha2(F.col(content).cast("binary"), 256))
    nth = F.row_number().over(Window.partitionBy("doc_id", "sha256").orderBy("page", "pos"))
    return hashed.withColumn("_n", nth).filter("_n = 1").drop("_n")


def limit_per_page(visuals: DataFrame, limit: int = IMAGE_LIMIT) -> DataFrame:
    """At most `limit` visuals of a page, and only pages that start below the document's limit."""
    by_page = visuals.groupBy("doc_id", "page").agg(F.least(F.count(F.lit(1)), F.lit(limit)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = by_page.withColumn("before", before).filter(F.col("before") < limit).select("doc_id", "page")
    nth = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    return visuals.withColumn("_n", nth).filter(F.col("_n") <= limit).drop("_n").join(open_, ["doc_id", "page"], "left_semi")
