"""Document types by weighted indicator terms in the text and key phrases, with bonuses of size, pages and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Indicator terms and weights by document type, in order of declaration.
INDICATORS = {
    "invoice": {"invoice": 15, "bill to": 10, "invoice no": 15, "invoice date": 10, "due date": 10, "payment terms": 10, "subtotal": 8, "total amount": 8, "amount due": 10, "tax id": 5, "purchase order": 5, "account number": 8, "po number": 8},
    "receipt": {"receipt": 15, "customer copy": 10, "merchant": 8, "total": 8, "change": 10, "cash": 5, "payment method": 10, "item": 5, "qty": 5, "thank you for your purchase": 10, "cashier": 8, "transaction": 8, "return policy": 8},
    "id": {"identification": 10, "identity card": 15, "date of birth": 15, "expiration date": 15, "license": 10, "passport": 15, "id number": 15, "document number": 15, "nationality": 10, "gender": 5, "signature": 5, "issued by": 10, "driver": 8},
    "business_card": {"tel": 8, "phone": 8, "email": 10, "www": 8, "website": 8, "fax": 5, "mobile": 8, "position": 10, "title": 8, "company": 10, "address": 8, "linkedin": 8, "ceo": 8, "director": 8},
    "tax": {"w-2": 20, "w2": 20, "wage": 8, "tax statement": 15, "earnings summary": 10, "federal income tax": 15, "social security tax": 15, "medicare tax": 15, "employer identification number": 15, "tax year": 10, "1099": 20, "tax form": 15, "irs": 15, "filing status": 10},
}
# Least score and gap of a decision, size classes, factor of key phrases.
THRESHOLD, GAP, SMALL, MEDIUM, LARGE, PHRASE_FACTOR = 60, 15, 50_000, 100_000, 500_000, 1.5
# Bonuses by type for small, medium and large files, for one page, for three or more, and for tables.
BONUS = {
    "small": {"business_card": 15, "receipt": 10, "id": 5}, "medium": {"receipt": 15, "business_card": 5, "id": 10}, "large": {"invoice": 10, "tax": 10, "receipt": -5, "business_card": -10},
    "one_page": {"receipt": 10, "business_card": 15, "id": 10}, "many_pages": {"invoice": 10, "tax": 10, "receipt": -10, "business_card": -15}, "tables": {"invoice": 15, "tax": 10, "receipt": 5},
}
# Model names by document type, and the extensions that can be read.
MODEL_IDS = {"general": "prebuilt-document", "invoice": "prebuilt-invoice", "receipt": "prebuilt-receipt", "id": "prebuilt-idDocument", "tax": "prebuilt-tax.us.w2", "layout": "prebuilt-layout", "business_card": "prebuilt-businessCard", "read": "prebuilt-read"}
EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".pdf", ".tiff", ".tif", ".heif")


def type_scores(low: Column, keys: Column, file_size: Column, pages: Column, tables: Column) -> Column:
    """array of (score, -declaration order, type). low: the text, keys: its key phrases in one, both in lower case and both
    columns, as each is scanned once per term, in the JVM."""
    flags = {"small": file_size < SMALL, "medium": (file_size >= SMALL) & (file_size < MEDIUM), "large": file_size > LARGE, "one_page": pages == 1, "many_pages": pages >= 3, "tables": tables}
    out = []
    for order, (kind, terms) in enumerate(INDICATORS.items()):
        score = F.lit(0.0)
        for term, weight in terms.items():
            score = score + F.when(F.contains(low, F.lit(term)), float(weight)).otherwise(0.0)
            score = score + F.when(F.contains(keys, F.lit(term)), weight * PHRASE_FACTOR).otherwise(0.0)
        for name, bonus in BONUS.items():
            if kind in bonus:
                score = score + F.when(flags[name], float(bonus[kind])).otherwise(0.0)
        out.append(F.struct(score.alias("score"), F.lit(-order).alias("order"), F.lit(kind).alias("kind")))
    return F.array(*out)


def detect(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, key_phrases, file_size, page_count, has_tables. doc_id, top_type, top_score, gap, model."""
    joined = F.array_join(F.coalesce("key_phrases", F.array().cast("array<string>")), "\0")  # no term holds the separator
    texts = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"), F.lower(joined).alias("keys"), "file_size", "page_count", "has_tables")
    ranked = F.sort_array(type_scores(F.col("low"), F.col("keys"), F.col("file_size"), F.col("page_count"), F.col("has_tables")), asc=False)
    scored = texts.select("doc_id", ranked.alias("r")).select("doc_id", F.col("r")[0]["kind"].alias("top_type"), F.col("r")[0]["score"].alias("top_score"), (F.col("r")[0]["score"] - F.col("r")[1]["score"]).alias("gap"))
    chosen = F.when((F.col("top_score") >= THRESHOLD) & (F.col("gap") >= GAP), F.col("top_type")).otherwise("layout")
    return scored.withColumn("model", chosen)


def model_id(kind: Column) -> Column:
    """The model's name; unknown kinds have none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in MODEL_IDS.items() for x in pair]), kind)


def choose_model(forced: Column, automatic: Column, detected: Column) -> Column:
    """Forced wins, then the detected one if detection is on, else layout."""
    return F.coalesce(F.nullif(forced, F.lit("")), F.when(automatic, detected), F.lit("layout"))


def readable(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1)).isin(*EXTENSIONS)
