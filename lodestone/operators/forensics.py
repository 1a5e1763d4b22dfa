"""Document forensics as rules over facts: metadata, PDF structure, text, images; indicators, risk and categories.

Facts come as columns (maps, arrays, structs) from the parsers in lodestone.adapters or any other source; every rule is
a Column that gives an indicator or null, so all rules of a document are one projection. Order of indicators is the
order of the rules. Indicator sentences are this engine's own; each carries a word by which it is categorised.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Essential fields, editing tools by kind of document, EXIF fields, brand aliases, ISO range.
PDF_ESSENTIAL = ("CreationDate", "Producer", "Creator")
PDF_TOOLS = ("GIMP", "Photoshop", "Paint", "ABBYY", "Microsoft Paint")
IMAGE_ESSENTIAL = ("EXIF DateTimeOriginal", "Image Make", "Image Model")
IMAGE_DATES = ("EXIF DateTimeOriginal", "EXIF DateTimeDigitized", "Image DateTime")
IMAGE_SOFTWARE = ("Image Software", "EXIF Software")
IMAGE_TOOLS = ("GIMP", "Photoshop", "Lightroom", "Paint", "ABBYY", "Inkscape", "CorelDRAW", "Pixlr", "Capture One", "Darktable", "Paint.NET", "PhotoScape", "Pixelmator", "Snapseed")
ALL_TOOLS = (*IMAGE_TOOLS, "Microsoft Paint")
GPS_FIELDS = ("GPS GPSLatitude", "GPS GPSLongitude", "GPS GPSLatitudeRef", "GPS GPSLongitudeRef", "GPS GPSTimeStamp", "GPS GPSDateStamp")
BRANDS = {"canon": ("canon",), "nikon": ("nikon",), "sony": ("sony", "ilce", "dsc"), "apple": ("iphone", "ipad"), "samsung": ("sm-", "galaxy"), "google": ("pixel",), "oneplus": ("oneplus",)}
ISO_RANGE = (50, 102_400)
# Keywords of categories, in order; the rest is metadata.
CATEGORIES = {
    "metadata": ("metadata", "date", "software", "missing", "creator", "producer"),
    "image": ("image", "manipulation", "ela", "ghost", "copy-move", "noise", "shadow", "edge", "cfa"),
    "structure": ("structure", "javascript", "layer", "update", "signature", "encrypted", "embedded", "filter"),
    "text": ("font", "text"),
}
# Usual stream filters, formats, risk levels by least score.
USUAL_FILTERS = ("/FlateDecode", "/DCTDecode")
PDF_EXTENSIONS, IMAGE_EXTENSIONS = (".pdf",), (".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".tif")
LEVELS = (("Low", 0), ("Medium", 20), ("High", 50), ("Very High", 80))
INDICATOR_SHARE, SMALL_IMAGE, PREVIEW_CHARS, PREVIEW_BLOCKS, LISTED_PAGES = 20, 100, 500, 2, 5


@dataclass(frozen=True)
class Config:
    """Limits and thresholds; sections are general and thresholds."""

    log_level: str = "INFO"
    max_pdf_pages: int = 20
    max_images: int = 50
    jpeg_quality: int = 95
    ela_mean_threshold: float = 5.0
    ela_std_threshold: float = 10.0
    noise_mean_threshold: float = 2.0
    noise_std_threshold: float = 3.0
    copy_move_threshold: int = 10
    ghost_ratio_threshold: float = 0.05
    shadow_direction_threshold: float = 45.0
    straight_lines_threshold: int = 5
    discontinuity_ratio_threshold: float = 0.2
    cfa_suspicious_ratio_threshold: float = 0.1
    font_count_threshold: int = 3

    GENERAL = ("log_level", "max_pdf_pages", "max_images", "jpeg_quality")

    def __post_init__(self):
        if self.log_level not in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
            raise ValueError(f"log_level {self.log_level!r}")
        if self.max_pdf_pages < 1 or self.max_images < 1 or not 1 <= self.jpeg_quality <= 100:
            raise ValueError("limits must be positive and jpeg_quality within 1 to 100")
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name.endswith("_threshold") and value < 0 or f.name in ("ghost_ratio_threshold", "cfa_suspicious_ratio_threshold") and value > 1:
                raise ValueError(f"{f.name} = {value}")

    @classmethod
    def from_dict(cls, given: dict) -> Config:
        """Flat, or by section."""
        flat = {k: v for k, v in given.items() if not isinstance(v, dict)} | {k: v for part in given.values() if isinstance(part, dict) for k, v in part.items()}
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in flat.items() if k in known})

    def to_dict(self) -> dict:
        every = asdict(self)
        return {"general": {k: every[k] for k in self.GENERAL}, "thresholds": {k: v for k, v in every.items() if k not in self.GENERAL}}

    def get(self, section: str, key: str, default=None):
        return self.to_dict().get(section, {}).get(key, default)

    def update(self, **changes) -> Config:
        return replace(self, **changes)


def holds(word: str, lower: bool = False):
    """A test for array elements: the word occurs (in either case)."""
    return lambda v: F.contains(F.lower(v), F.lit(word.lower())) if lower else F.contains(v, F.lit(word))


def indicators(*rules: Column) -> Column:
    """The indicators that hold, in order."""
    return F.array_compact(F.array(*rules))


def lacking(meta: Column, names: tuple[str, ...]) -> Column:
    return F.filter(F.array(*map(F.lit, names)), lambda n: ~F.map_contains_key(meta, n))


def named(meta: Column, key: str) -> Column:
    return F.try_element_at(meta, F.lit(key))


def pdf_metadata_rules(meta: Column) -> Column:
    """meta: map<string,string>, null if the document has none."""
    created, changed = named(meta, "CreationDate"), named(meta, "ModDate")
    missing = lacking(meta, PDF_ESSENTIAL)
    used = lambda tool: F.exists(F.map_values(meta), holds(tool, lower=True))
    out = indicators(
        F.when((created != "") & (changed != "") & (created > changed), "metadata: created after the last change"),
        F.when(F.size(missing) > 0, F.concat(F.lit("metadata: missing "), F.array_join(missing, ", "))),
        *[F.when(used(t), f"metadata: written by the software {t}") for t in PDF_TOOLS],
    )
    return F.when(meta.isNull(), F.array(F.lit("metadata: missing altogether"))).otherwise(out)


def image_metadata_rules(meta: Column) -> Column:
    missing = lacking(meta, IMAGE_ESSENTIAL)
    dates = F.array_distinct(F.filter(F.array(*[named(meta, d) for d in IMAGE_DATES]), lambda d: d.isNotNull()))
    software = F.filter(F.array(*[named(meta, s) for s in IMAGE_SOFTWARE]), lambda s: F.coalesce(s != "", F.lit(False)))
    out = indicators(
        F.when(F.size(missing) > 0, F.concat(F.lit("metadata: missing "), F.array_join(missing, ", "))),
        F.when(F.size(dates) > 1, "metadata: dates disagree"),
        *[F.when(F.exists(software, holds(t)), f"metadata: image edited by the software {t}") for t in IMAGE_TOOLS],
    )
    return F.when(meta.isNull() | (F.cardinality(meta) == 0), F.array(F.lit("metadata: missing altogether"))).otherwise(out)


def camera_rules(meta: Column) -> Column:
    """Standalone checks: tools anywhere, GPS, make against model, sensitivity."""
    missing = lacking(meta, GPS_FIELDS)
    place = [named(meta, k) for k in GPS_FIELDS[:2]]
    make, model = (F.trim(F.coalesce(named(meta, k), F.lit(""))) for k in ("Image Make", "Image Model"))
    low_make, low_model = F.lower(make), F.lower(model)
    known = F.lit(False)
    for brand, names in BRANDS.items():
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(low_model, F.lit(n))
        known = known | (F.contains(low_make, F.lit(brand)) & hit)
    iso = named(meta, "EXIF ISOSpeedRatings").try_cast("bigint")
    infinite = (place[0] != "") & (place[1] != "") & (F.contains(F.lower(place[0]), F.lit("inf")) | F.contains(F.lower(place[1]), F.lit("inf")))
    return indicators(
        *[F.when(F.exists(F.map_values(meta), holds(t, lower=True)), f"metadata: edited by the software {t}") for t in ALL_TOOLS],
        F.when((F.size(missing) > 2) & (F.size(missing) < len(GPS_FIELDS)), F.concat(F.lit("metadata: GPS is missing "), F.array_join(F.slice(missing, 1, 3), ", "))),
        F.when(infinite, "metadata: GPS position is not finite"),
        F.when((make != "") & (model != "") & (F.length(make) > 3) & ~F.contains(low_model, low_make) & ~known, F.concat(F.lit("metadata: make "), make, F.lit(" and model "), model, F.lit(" disagree"))),
        F.when((iso < ISO_RANGE[0]) | (iso > ISO_RANGE[1]), F.concat(F.lit("metadata: unusual ISO "), iso.cast("string"))),
    )


def metadata_summary(meta: Column) -> Column:
    any_of = lambda *names: F.exists(F.array(*map(F.lit, names)), lambda n: F.map_contains_key(meta, n))
    return F.struct(
        F.cardinality(meta).alias("total_fields"), any_of("CreationDate", "EXIF DateTimeOriginal", "Image DateTime").alias("has_creation_date"), any_of("Producer", "Creator", "Image Software", "EXIF Software").alias("has_software_info"),
        any_of("Image Make", "Image Model", "EXIF Model").alias("has_camera_info"), any_of("GPS GPSLatitude", "GPS GPSLongitude").alias("has_gps_info"),
    )


def key_metadata(meta: Column) -> Column:
    """The key fields that are present; the position always."""
    first = lambda *names: F.coalesce(*[F.nullif(named(meta, n), F.lit("")) for n in names])
    pairs = {k: named(meta, k) for k in ("CreationDate", "ModDate", "Producer", "Creator")} | {
        "DateTime": first("EXIF DateTimeOriginal", "Image DateTime"), "Make": named(meta, "Image Make"),
        "Model": named(meta, "Image Model"), "Software": first("Image Software", "EXIF Software"),
    }
    kept = F.map_filter(F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return F.struct(kept.alias("fields"), F.struct(named(meta, "GPS GPSLatitude").alias("latitude"), named(meta, "GPS GPSLongitude").alias("longitude")).alias("gps"))


def latin(content: Column) -> Column:
    """Bytes as one character each."""
    return F.decode(content, "ISO-8859-1")


def pdf_facts(content: Column) -> Column:
    """What the raw bytes of a PDF tell without a parser."""
    text = latin(content)
    return F.struct(
        F.regexp_extract(latin(F.substring(content, 1, 16)), r"%PDF-([^\r\n]*)", 1).alias("header_version"),
        F.regexp_extract(text, r"/Version\s*/([0-9.]+)", 1).alias("catalog_version"),
        text.rlike(r"/(?:JS|JavaScript)\b").alias("has_javascript"),
        text.rlike(r"/FT\s*/Sig\b").alias("has_signatures"),
        text.rlike(r"/Encrypt\b").alias("is_encrypted"),
        text.rlike(r"/OCProperties\b").alias("has_layers"),
        F.regexp_count(text, F.lit(r"/Type\s*/OCG\b")).alias("n_layers"),
        (F.regexp_count(text, F.lit("%%EOF")) - 1).alias("incremental_updates"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(r"/Filter\s*\[?\s*(/[A-Za-z0-9]+)"), F.lit(1))).alias("filters"),
        F.regexp_extract_all(text, F.lit(r"/Type\s*/EmbeddedFile\b[^>]*?/F\s*\(([^)]*)\)"), F.lit(1)).alias("embedded_files"),
        F.regexp_count(text, F.lit(r"\b[0-9]+ [0-9]+ obj\b")).alias("n_objects"),
        F.regexp_count(text, F.lit(r"/Subtype\s*/Image\b")).alias("n_images"),
    )


def embedded_names(names: Column) -> Column:
    """Of a flat name tree [name, file, name, file ...] the names."""
    return F.filter(names, lambda x, i: i % 2 == 0)


def uncommon_filters(filters: Column) -> Column:
    return F.array_except(filters, F.array(*map(F.lit, USUAL_FILTERS)))


def pdf_structure_rules(facts: Column) -> Column:
    odd = uncommon_filters(facts["filters"])
    return indicators(
        F.when((facts["catalog_version"] != "") & (facts["header_version"] != facts["catalog_version"]), "structure: header and catalogue versions differ"),
        F.when(facts["has_javascript"], "structure: holds JavaScript"),
        F.when(facts["is_encrypted"], "structure: encrypted"),
        F.when(facts["incremental_updates"] > 0, F.concat(F.lit("structure: incremental updates: "), facts["incremental_updates"].cast("string"))),
        F.when(F.size(facts["embedded_files"]) > 0, F.concat(F.lit("structure: embedded files: "), F.size(facts["embedded_files"]).cast("string"))),
        F.when(F.size(odd) > 0, F.concat(F.lit("structure: uncommon filters: "), F.array_join(F.array_sort(odd), ", "))),
        F.when(facts["has_layers"], "structure: optional layers"),
    )


def image_rules(images: Column) -> Column:
    """images: array of (width, height)."""
    small = F.filter(images, lambda i: (i["width"] < SMALL_IMAGE) | (i["height"] < SMALL_IMAGE))
    return indicators(F.when(F.size(small) > 0, F.concat(F.lit("image: very small ones: "), F.size(small).cast("string"))))


def pixel_rules(m: Column, config: Config = Config()) -> Column:
    """m: struct of kernel metrics (lodestone.functions.kernels); absent metrics are null and give nothing."""
    return indicators(
        F.when((m["ela_mean"] > config.ela_mean_threshold) | (m["ela_std"] > config.ela_std_threshold) | (m["ela_max"] > 50), "image: error level (ela) is uneven"),
        F.when(m["copy_move_matches"] > config.copy_move_threshold, "image: copy-move matches"),
        F.when((m["noise_mean_spread"] > config.noise_mean_threshold) | (m["noise_std_spread"] > config.noise_std_threshold), "image: noise is uneven"),
        F.when((m["straight_lines"] > config.straight_lines_threshold) | (m["discontinuity_ratio"] > config.discontinuity_ratio_threshold), "image: edge breaks"),
        F.when(m["ghost_ratio"] > config.ghost_ratio_threshold, "image: JPEG ghost"),
        F.when((m["quantization_tables"] > 2) | m["odd_quantization"], "image: unusual quantisation"),
        F.when(m["shadow_spread"] > config.shadow_direction_threshold, "image: shadow directions disagree"),
        F.when(m["cfa_ratio"] > config.cfa_suspicious_ratio_threshold, "image: cfa pattern is broken"),
    )


def fonts(chars: DataFrame, max_pages: int = Config.max_pdf_pages) -> DataFrame:
    """chars: doc_id, page (from 1), font. doc_id, font, n: characters by font on the first pages."""
    return chars.filter(F.col("page") <= max_pages).groupBy("doc_id", "font").agg(F.count(F.lit(1)).alias("n"))


def font_rules(counted: DataFrame, threshold: int = Config.font_count_threshold) -> DataFrame:
    """doc_id, distinct_fonts, font_distribution, indicator (null if there are not too many)."""
    by_font = F.map_from_entries(F.array_sort(F.collect_list(F.struct("font", "n"))))
    by_doc = counted.groupBy("doc_id").agg(F.count(F.lit(1)).alias("distinct_fonts"), by_font.alias("font_distribution"))
    said = F.concat(F.lit("text: fonts: "), F.col("distinct_fonts").cast("string"))
    return by_doc.withColumn("indicator", F.when(F.col("distinct_fonts") > threshold, said))


def first_pages(pages: DataFrame, limit: int, order: str = "page", key: str = "doc_id") -> DataFrame:
    """The first rows of each document."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter(F.col("_n") <= limit).drop("_n")


def previews(blocks: DataFrame) -> DataFrame:
    """blocks: doc_id, page, text. doc_id, pages_with_text, total_text_length, text_blocks (first two, cut)."""
    shown = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("page", "text"))), 1, PREVIEW_BLOCKS), lambda b: F.struct(b["page"].alias("page"), F.left(b["text"], F.lit(PREVIEW_CHARS)).alias("text"), F.char_length(b["text"]).alias("char_count")))
    return blocks.filter("text <> ''").groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages_with_text"), F.sum(F.char_length("text")).alias("total_text_length"), shown.alias("text_blocks"))


def page_rollup(page_issues: DataFrame) -> DataFrame:
    """page_issues: doc_id, page, issue. doc_id, indicators: listed by page, or one line if there are more than LISTED_PAGES."""
    line = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(": "), F.col("issue"))
    grouped = page_issues.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "issue", line.alias("line")))).alias("rows"), F.array_sort(F.collect_set("page")).alias("pages"))
    many = F.array(F.concat(F.lit("image: issues on pages "), F.array_join(F.transform("pages", lambda p: p.cast("string")), ", ")))
    return grouped.select("doc_id", F.when(F.size("rows") > LISTED_PAGES, many).otherwise(F.transform("rows", lambda r: r["line"])).alias("indicators"))


def risk_score(count: Column) -> Column:
    return F.least(F.lit(100), F.floor(count * 100 / INDICATOR_SHARE).cast("int"))


def risk_level(score: Column) -> Column:
    out = F.lit(LEVELS[0][0])
    for name, least in LEVELS[1:]:
        out = F.when(score >= least, name).otherwise(out)
    return out


def category(indicator: Column) -> Column:
    """The first category one of whose words occurs."""
    low = F.lower(indicator)
    out = F.lit("metadata")
    for name, words in reversed(CATEGORIES.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(low, F.lit(w))
        out = F.when(hit, name).otherwise(out)
    return out


def assess(docs: DataFrame, column: str = "indicators") -> DataFrame:
    """docs with risk_score, risk_level, issues by category and roll-up flags."""
    score = risk_score(F.size(column))
    of = lambda name: F.filter(column, lambda i: category(i) == name)
    out = docs.withColumn("risk_score", score).withColumn("risk_level", risk_level(score)).withColumn("total_issues", F.size(column)).withColumn("is_high_risk", score >= 50)
    for name in CATEGORIES:
        out = out.withColumn(f"{name}_issues", of(name)).withColumn(f"has_{name}_issues", F.size(f"{name}_issues") > 0)
    return out


def risk_distribution(assessed: DataFrame) -> DataFrame:
    """risk_level, n: all levels, 0 where none."""
    spark = assessed.sparkSession
    levels = spark.createDataFrame([(n,) for n, _ in LEVELS], "risk_level string")
    found = assessed.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(found, "risk_level", "left").select("risk_level", F.coalesce("n", F.lit(0)).alias("n"))


def kind_of(path: Column) -> Column:
    """pdf, image or null for formats that are not analysed."""
    end = F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))
    return F.when(end.isin(*PDF_EXTENSIONS), "pdf").when(end.isin(*IMAGE_EXTENSIONS), "image")


def analyze(files: DataFrame) -> DataFrame:
    """files: path, content and optionally metadata (map). One assessed row per file; formats that are not analysed have an error."""
    given = files if "metadata" in files.columns else files.withColumn("metadata", F.lit(None).cast("map<string,string>"))
    kind, facts = kind_of(F.col("path")), pdf_facts(F.col("content"))
    found = F.when(kind == "pdf", F.concat(pdf_metadata_rules(F.col("metadata")), pdf_structure_rules(facts))).when(kind == "image", image_metadata_rules(F.col("metadata"))).otherwise(F.array().cast("array<string>"))
    return assess(given.withColumn("kind", kind).withColumn("indicators", found)).withColumn("error", F.when(F.col("kind").isNull(), F.concat(F.lit("unsupported format: "), F.col("path")))).withColumn("analysis_successful", F.col("kind").isNotNull()).drop("content")
