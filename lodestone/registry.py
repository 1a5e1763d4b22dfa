"""Queries over the driver's tables, one or more for each operator, with the same results as SQL where SQL has them.

All queries read whole tables. Tables that the operators need and that are not there (files, e-mails, PDF facts) are
derived from whole ones by plain expressions, the same in both languages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import kernels, similarity, text
from lodestone.operators import doctype, email, forensics, neighbors, pii, ranking, structure, text_quality
from lodestone.plans import schema
from lodestone.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PATTERN_TYPES = ["EMAIL_ADDRESS", "IP_ADDRESS", "US_SSN", "PHONE_NUMBER"]
CLEAN = r"list_transform(list_filter(regexp_split_to_array(coalesce({0}, ''), '[\x09-\x0D\x1C-\x1F\x{{85}}\p{{Z}}]+'), lambda x: regexp_full_match(x, '\p{{L}}{{3,}}')), lambda x: lower(x))"
NORMAL = r"trim(regexp_replace(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- text -------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, coalesce(array_to_string({CLEAN.format('text')}, ' '), '') AS clean FROM documents")
def clean_text(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query("SELECT doc_id, sha256(translate(text, 'áéíóúÁÉÍÓÚñÑüÜ', 'aeiouAEIOUnNuU')) AS folded FROM documents")
def fold_spanish(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.fold_spanish(F.col("text")), 256).alias("folded"))


@query(f"SELECT doc_id, {NORMAL.format('text')} AS normal FROM documents")
def normal_name(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normal_name(F.col("text")).alias("normal"))


@query(r"SELECT page_id, split_part(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '^www\.', ''), '/', 1) AS domain FROM pages")
def website_domain(spark, d):
    return table(spark, d, "pages").select("page_id", text.domain(F.col("url")).alias("domain"))


@query("""SELECT doc_id, CASE WHEN b < 1024 THEN printf('%d bytes', b) WHEN b < 1048576 THEN printf('%.2f KB', b / 1024.0) WHEN b < 1073741824 THEN printf('%.2f MB', b / 1048576.0) ELSE printf('%.2f GB', b / 1073741824.0) END AS size
FROM (SELECT doc_id, n_chars * (1 + (doc_id % 7) * (doc_id % 7) * 40000) AS b FROM documents)""")
def human_size(spark, d):
    return table(spark, d, "documents").select("doc_id", text.human_size(F.expr("n_chars * (1 + (doc_id % 7) * (doc_id % 7) * 40000)")).alias("size"))


@query(r"""WITH n AS (SELECT page_id, regexp_replace(translate(url, '<>:"/\|?*', '_________'), '^[ .]+|[ .]+$', '', 'g') AS a FROM pages),
m AS (SELECT page_id, CASE WHEN a = '' THEN 'unnamed_attachment' ELSE a END AS a FROM n)
SELECT page_id, CASE WHEN length(a) > 200 THEN substr(a, 1, 200 - length(regexp_extract(a, '(\.[^.]*)$', 1))) || regexp_extract(a, '(\.[^.]*)$', 1) ELSE a END AS name FROM m""")
def safe_filename(spark, d):
    return table(spark, d, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name"))


@query("""SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN source || '.pdf' ELSE ' ' END), ''), nullif(trim(CASE WHEN doc_id % 3 = 1 THEN lang END), ''), 'attachment_' || CAST(doc_id % 5 + 1 AS VARCHAR)) AS name FROM documents""")
def attachment_name(spark, d):
    name = text.attachment_name(F.expr("CASE WHEN doc_id % 3 = 0 THEN source || '.pdf' ELSE ' ' END"), F.expr("CASE WHEN doc_id % 3 = 1 THEN lang END"), F.lit(None).cast("string"), F.col("doc_id") % 5)
    return table(spark, d, "documents").select("doc_id", name.alias("name"))


NAMES = ["a.PDF", "b.txt", "c.jpeg", "d.docx", "e", "f.unknown", "g.msg"]
NAME_SQL = "list_extract([" + ", ".join(f"'{n}'" for n in NAMES) + "], CAST({0} % 7 AS INTEGER) + 1)"
MIME_CASE = "CASE regexp_extract(lower({0}), '(\\.[^./]+)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.MIME_TYPES.items()) + " ELSE 'application/octet-stream' END"


def name_column(col: str):
    return F.element_at(F.array(*map(F.lit, NAMES)), (F.col(col) % 7 + 1).cast("int"))


@query(f"SELECT content_type, count(*) AS n, sum(n_chars) AS total_bytes, round(sum(n_chars) / 1048576.0, 2) AS total_mb FROM (SELECT {MIME_CASE.format(NAME_SQL.format('doc_id'))} AS content_type, n_chars FROM documents) GROUP BY 1")
def mime_stats(spark, d):
    typed = table(spark, d, "documents").select(text.mime_type(name_column("doc_id")).alias("content_type"), "n_chars")
    return typed.groupBy("content_type").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("total_bytes"), F.round(F.sum("n_chars") / 1048576, 2).alias("total_mb"))


@query("""WITH t AS (SELECT conv_id, list([role, text] ORDER BY turn) AS r FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(r, lambda c, i: '| ' || c[1] || ' | ' || coalesce(c[2], '') || ' |' || chr(10) || CASE WHEN i = 1 THEN '|---|---|' || chr(10) ELSE '' END), '') AS markdown FROM t""")
def markdown_table(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.array("role", "text").alias("cells")))).alias("r"))
    return rows.select("conv_id", text.markdown_table(F.transform("r", lambda x: x["cells"])).alias("markdown"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, least(l_extendedprice, 600)) AS x FROM lineitem")
def clamp_box(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", text.clamp(F.col("l_extendedprice"), F.lit(0.0), F.lit(600.0)).alias("x"))


# --- text quality -----------------------------------------------------------------------------------------------------

RATIOS = f"""v AS (SELECT DISTINCT unnest({CLEAN.format('text')}) AS word FROM benchmark),
w AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({CLEAN.format('text')}) AS word FROM docs) GROUP BY 1, 2),
k AS (SELECT w.*, v.word IS NOT NULL AS known FROM w LEFT JOIN v USING (word)),
g AS (SELECT doc_id, sum(n) AS n_tokens, sum(CASE WHEN known THEN 1 ELSE 0 END) AS ks, sum(CASE WHEN known THEN 0 ELSE 1 END) AS us, sum(CASE WHEN known THEN n ELSE 0 END) AS kt, sum(CASE WHEN known THEN 0 ELSE n END) AS ut FROM k GROUP BY 1),
r AS (SELECT doc_id, coalesce(n_tokens, 0) AS n_tokens, CASE WHEN coalesce(us, 0) + coalesce(ks, 0) = 0 THEN 0 WHEN ks = 0 THEN 1e9 ELSE us::DOUBLE / ks END AS set_ratio, CASE WHEN coalesce(ut, 0) + coalesce(kt, 0) = 0 THEN 0 WHEN kt = 0 THEN 1e9 ELSE ut::DOUBLE / kt END AS token_ratio FROM docs LEFT JOIN g USING (doc_id))"""


def finite(name: str):
    return F.round(F.least(F.col(name), F.lit(1e9)), 6).alias(name)


@query(f"WITH docs AS (SELECT doc_id, text FROM documents), {RATIOS} SELECT doc_id, CAST(n_tokens AS BIGINT) AS n_tokens, round(set_ratio, 6) AS set_ratio, round(token_ratio, 6) AS token_ratio FROM r")
def gibberish_ratios(spark, d):
    vocabulary = text_quality.vocabulary_of(table(spark, d, "benchmark"))
    return text_quality.gibberish_ratios(table(spark, d, "documents").select("doc_id", "text"), vocabulary).select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"), finite("set_ratio"), finite("token_ratio"))


@query(f"WITH docs AS (SELECT doc_id, text FROM documents), {RATIOS} SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN FALSE WHEN n_tokens <= 10 THEN TRUE ELSE least(set_ratio, token_ratio) < 0.7 END AS valid FROM docs JOIN r USING (doc_id)")
def text_validity(spark, d):
    return text_quality.validity(table(spark, d, "documents"), text_quality.vocabulary_of(table(spark, d, "benchmark")))


HALVES = "substr(text, 1, CAST(floor(n_chars * (doc_id % 5) / 4) AS INTEGER))", "substr(text, 1 + CAST(floor(n_chars * (doc_id % 5) / 4) AS INTEGER))"


@query(f"""WITH h AS (SELECT doc_id, lang, {HALVES[0]} AS digital, {HALVES[1]} AS ocr FROM documents),
docs AS (SELECT doc_id, CASE WHEN lang = 'es' THEN translate(array_to_string({CLEAN.format('ocr')}, ' '), 'áéíóúÁÉÍÓÚñÑüÜ', 'aeiouAEIOUnNuU') ELSE ocr END AS text FROM h), {RATIOS},
c AS (SELECT doc_id, len({CLEAN.format('digital')}) AS a, len({CLEAN.format('ocr')}) AS b FROM h)
SELECT doc_id, CASE WHEN a + b = 0 THEN 'low' WHEN a::DOUBLE / (a + b) > 0.7 THEN 'high' WHEN least(set_ratio, token_ratio) > 0.25 THEN 'low' ELSE 'medium' END AS confidence FROM c JOIN r USING (doc_id)""")
def text_confidence(spark, d):
    halves = table(spark, d, "documents").select("doc_id", "lang", *[F.expr(e).alias(n) for e, n in zip(HALVES, ("digital", "ocr"), strict=True)])
    return text_quality.confidence(halves, text_quality.vocabulary_of(table(spark, d, "benchmark")))


# --- personal data ----------------------------------------------------------------------------------------------------


def sql_pattern(e: str) -> str:
    return pii.PATTERNS[e][0].replace("'", "''")


MATCHES = " UNION ALL ".join(f"SELECT doc_id, lang, '{e}' AS entity_type, unnest(regexp_extract_all(coalesce(text, ''), '{sql_pattern(e)}')) AS entity_text FROM documents" for e in PATTERN_TYPES)


def typed_matches(e: str) -> str:
    """Matches of a type and the text between them."""
    pattern = sql_pattern(e)
    return f"""SELECT doc_id, '{e}' AS k, {pii.PATTERNS[e][1]}::DOUBLE AS score, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM documents WHERE regexp_matches(text, '{pattern}')"""


# Places from the lengths of what lies before; then, by score, length and start, each span that meets none taken before.
SPANS = f"""found AS ({" UNION ALL ".join(map(typed_matches, PATTERN_TYPES))}),
placed AS (SELECT doc_id, k, score, m, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS b, m[i] AS v FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found)),
sorted_spans AS (SELECT doc_id, list(struct_pack(k := k, b := CAST(b AS INTEGER), e := CAST(b + length(v) AS INTEGER), v := v, score := score) ORDER BY score DESC, length(v) DESC, b, k) AS s FROM placed GROUP BY doc_id),
chosen AS (SELECT doc_id, list_reduce(s, lambda acc, x: CASE WHEN len(list_filter(acc, lambda t: x.b < t.e AND t.b < x.e)) = 0 THEN list_append(acc, x) ELSE acc END, s[1:0]) AS s FROM sorted_spans),
spans AS (SELECT d.doc_id, d.text, list_sort(coalesce(list_transform(s, lambda x: struct_pack(b := x.b, e := x.e, k := x.k, v := x.v, score := x.score)), [])) AS s FROM documents d LEFT JOIN chosen USING (doc_id))"""


def rebuilt(replacement: str) -> str:
    """SQL of the text with each span x replaced."""
    return f"array_to_string(list_transform(s, lambda x, i: substr(text, CASE WHEN i = 1 THEN 1 ELSE s[i - 1].e + 1 END, x.b - CASE WHEN i = 1 THEN 0 ELSE s[i - 1].e END) || {replacement}), '') || substr(text, coalesce(s[-1].e, 0) + 1)"


@query(f"WITH {SPANS} SELECT doc_id, x.k AS entity_type, x.b AS start, x.e AS \"end\", x.v AS entity_text FROM (SELECT doc_id, unnest(s) AS x FROM spans)")
def pii_entities(spark, d):
    return pii.extract(table(spark, d, "documents"), PATTERN_TYPES)


@query(f"SELECT lang, entity_type, count(DISTINCT doc_id) AS n_documents, count(*) AS n_matches FROM ({MATCHES}) GROUP BY 1, 2")
def pii_summary(spark, d):
    return pii.pii_summary(table(spark, d, "documents"), PATTERN_TYPES)


def digest_of_anonymised(spark, d, config: dict) -> DataFrame:
    made = pii.anonymize(table(spark, d, "documents"), config, PATTERN_TYPES)
    return made.select("doc_id", F.sha2("anonymised", 256).alias("anonymised"))


@query(f"WITH {SPANS} SELECT doc_id, sha256({rebuilt("'<' || x.k || '>'")}) AS anonymised FROM spans")
def anonymize_replace(spark, d):
    return digest_of_anonymised(spark, d, {})


@query(f"WITH {SPANS} SELECT doc_id, sha256({rebuilt("''")}) AS anonymised FROM spans")
def anonymize_redact(spark, d):
    return digest_of_anonymised(spark, d, {"DEFAULT": {"type": "redact"}})


MASKED = {"DEFAULT": {"type": "mask", "masking_char": "#", "chars_to_mask": 4}, "IP_ADDRESS": {"type": "hash"}}
MASK_SQL = "CASE WHEN x.k = 'IP_ADDRESS' THEN sha256(x.v) ELSE left(x.v, length(x.v) - 4) || '####' END"


@query(f"WITH {SPANS} SELECT doc_id, sha256({rebuilt(MASK_SQL)}) AS anonymised FROM spans")
def anonymize_mask(spark, d):
    return digest_of_anonymised(spark, d, MASKED)


@query(f"""WITH {SPANS}, masked AS (SELECT *, {rebuilt(MASK_SQL)} AS masked FROM spans),
kinds AS (SELECT doc_id, string_agg(k || '=' || n, ',' ORDER BY k) AS by_type FROM (SELECT doc_id, k, count(*) AS n FROM (SELECT doc_id, unnest(s).k AS k FROM spans) GROUP BY 1, 2) GROUP BY 1)
SELECT doc_id, CAST(len(s) AS INTEGER) AS total, coalesce(by_type, '') AS by_type, CAST(length(text) AS INTEGER) AS original_length, CAST(length(masked) AS INTEGER) AS anonymised_length, CAST(length(text) - length(masked) AS INTEGER) AS delta,
round(CASE WHEN len(s) = 0 THEN 0 ELSE list_avg(list_transform(s, lambda x: x.score)) END, 6) AS mean_score FROM masked LEFT JOIN kinds USING (doc_id)""")
def anonymize_summary(spark, d):
    made = pii.summary(pii.anonymize(table(spark, d, "documents"), MASKED, PATTERN_TYPES))
    by_type = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return made.select("doc_id", "total", by_type.alias("by_type"), "original_length", "anonymised_length", "delta", F.round("mean_score", 6).alias("mean_score"))


@query()
def anonymize_keywords(spark, d):
    return pii.anonymize(table(spark, d, "conversations"), keywords=True, entities=PATTERN_TYPES).select("conv_id", "turn", "anonymised", "original_length", "anonymised_length")


@query("SELECT lang, lang IN ('en', 'es', 'fr', 'it') AS supported, count(*) AS n FROM documents GROUP BY 1, 2")
def language_support(spark, d):
    return table(spark, d, "documents").groupBy("lang", pii.supported_language(F.col("lang")).alias("supported")).agg(F.count(F.lit(1)).alias("n"))


# --- similarity and ranking -------------------------------------------------------------------------------------------

SAMPLE_PHONES = ("'+1-555-' || lpad(CAST(doc_id % 10000 AS STRING), 4, '0')", "CASE WHEN doc_id % 3 = 0 THEN '555 ' || lpad(CAST(doc_id % 10000 AS STRING), 4, '0') WHEN doc_id % 3 = 1 THEN '9714485' || CAST(doc_id AS STRING) ELSE '12' END")
SAMPLE_ZIPS = ("lpad(CAST(doc_id % 100000 AS STRING), 5, '0')", "CASE WHEN doc_id % 4 = 0 THEN lpad(CAST(doc_id % 100000 AS STRING), 5, '0') || '-6789' WHEN doc_id % 4 = 1 THEN ' ' || lpad(CAST(doc_id % 100000 AS STRING), 5, '0') WHEN doc_id % 4 = 2 THEN '' ELSE 'AB1' END")


@query(rf"""WITH p AS (SELECT doc_id, regexp_replace({SAMPLE_PHONES[0]}, '\D', '', 'g') AS a, regexp_replace({SAMPLE_PHONES[1]}, '\D', '', 'g') AS b FROM documents)
SELECT doc_id, CASE WHEN least(length(a), length(b)) >= 7 AND right(a, least(length(a), length(b))) = right(b, least(length(a), length(b))) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM p""")
def phone_match(spark, d):
    return table(spark, d, "documents").select("doc_id", similarity.phone_similarity(*map(F.expr, SAMPLE_PHONES)).alias("score"))


@query(rf"""WITH p AS (SELECT doc_id, regexp_replace({SAMPLE_ZIPS[0]}, '[\s\-]', '', 'g') AS a, regexp_replace({SAMPLE_ZIPS[1]}, '[\s\-]', '', 'g') AS b FROM documents)
SELECT doc_id, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN lower(a) = lower(b) THEN 1.0 WHEN length(a) >= 5 AND length(b) >= 5 AND left(a, 5) = left(b, 5) THEN 0.8 ELSE 0.0 END::DOUBLE AS score FROM p""")
def zip_match(spark, d):
    return table(spark, d, "documents").select("doc_id", similarity.zip_similarity(*map(F.expr, SAMPLE_ZIPS)).alias("score"))


@query(rf"""WITH p AS (SELECT p_partkey, {NORMAL.format('p_name')} AS a, {NORMAL.format("reverse(p_name)")} AS b, {NORMAL.format('p_brand')} AS c FROM part)
SELECT p_partkey, CASE WHEN a = b OR (p_partkey % 2 = 0 AND c = c) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM p""")
def identifier_match(spark, d):
    pairs = ((F.col("p_name"), F.reverse("p_name")), (F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_brand END"), F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", similarity.identifier_similarity(*pairs).alias("score"))


@query(r"""WITH RECURSIVE p AS (SELECT page_id, split_part(regexp_replace(regexp_replace(lower(url), '^https?://', ''), '^www\.', ''), '/', 1) AS a, 'www.example.org' AS u FROM pages),
q AS (SELECT page_id, a, 'example.org' AS b FROM p),
f AS (SELECT page_id, a, b, 0 AS i, list_transform(range(0, length(b) + 1), lambda z: 0) AS row FROM q UNION ALL
SELECT page_id, a, b, i + 1, list_reduce(range(1, length(b) + 1), lambda r, j: list_append(r, CASE WHEN substr(a, i + 1, 1) = substr(b, j, 1) THEN row[j] + 1 ELSE greatest(row[j + 1], r[j]) END), [0]) FROM f WHERE i < length(a))
SELECT page_id, round(2.0 * row[length(b) + 1] / (length(a) + length(b)), 6)::DOUBLE AS score FROM f WHERE i = length(a)""")
def website_similarity(spark, d):
    return table(spark, d, "pages").select("page_id", F.round(similarity.website_similarity(F.col("url"), F.lit("https://www.example.org/x")), 6).alias("score"))


IN_ORDER = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"


@query(f"""WITH RECURSIVE p AS (SELECT s_suppkey, {IN_ORDER.format(NORMAL.format("s_name || ' ' || n_name"))} AS x, {IN_ORDER.format(NORMAL.format("n_name || ' Supplier'"))} AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey),
f AS (SELECT s_suppkey, x, y, 0 AS i, list_transform(range(0, widest + 1), lambda z: 0) AS row FROM p CROSS JOIN (SELECT max(length(y)) AS widest FROM p) UNION ALL
SELECT s_suppkey, x, y, i + 1, list_reduce(range(1, len(row)), lambda r, j: list_append(r, CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN row[j] + 1 ELSE greatest(row[j + 1], r[j]) END), [0]) FROM f WHERE i < length(x))
SELECT s_suppkey, round(2.0 * row[length(y) + 1] / (length(x) + length(y)), 6)::DOUBLE AS score FROM f WHERE i = length(x)""")
def address_similarity(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    joined = s.join(n, s.s_nationkey == n.n_nationkey)
    return joined.select("s_suppkey", F.round(similarity.address_similarity(similarity.joined_address("s_name", "n_name"), similarity.joined_address("n_name", F.lit("Supplier"), F.lit(""))), 6).alias("score"))


def part_phone(prefix: str):
    return F.concat(F.lit(prefix), F.lpad((F.col("p_partkey") % 100).cast("string"), 2, "0"))


def part_candidates(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("provider_id"), F.col("p_name").alias("name"), F.col("p_brand").alias("provider_network"),
        F.col("p_type").alias("category"), part_phone("555-01").alias("phone_number"), F.col("p_partkey").alias("input_pos"),
    )


def part_queries(spark, d) -> DataFrame:
    name = F.concat("p_name", F.lit(" company")).alias("provider_legal_name")
    return table(spark, d, "part").filter("p_partkey % 100 = 0").select(F.col("p_partkey").cast("string").alias("query_id"), name, part_phone("+1 555-01").alias("phone_number"))


@query(f"""WITH t AS (SELECT unnest(list_concat(list_concat(string_split({NORMAL.format('p_name')}, ' '), string_split({NORMAL.format('p_brand')}, ' ')), string_split({NORMAL.format('p_type')}, ' '))) AS token FROM part),
n AS (SELECT greatest(1, floor(count(*) * 0.05)) AS least FROM part)
SELECT token, count(*) AS n FROM t WHERE length(token) > 2 AND NOT regexp_full_match(token, '[0-9]+') GROUP BY token HAVING count(*) >= (SELECT least FROM n)""")
def common_terms(spark, d):
    return ranking.common_terms(part_candidates(spark, d))


@query(f"""WITH w AS (SELECT p_partkey, string_split({NORMAL.format('p_name')} || ' ' || {NORMAL.format('p_brand')}, ' ') AS w FROM part),
t AS (SELECT p_partkey, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM w), n AS (SELECT count(*)::DOUBLE AS n FROM part)
SELECT term, round(ln((1 + (SELECT n FROM n)) / (1 + count(*))) + 1, 6) AS idf FROM t GROUP BY term HAVING count(*) <= 0.8 * (SELECT n FROM n)""")
def token_idf(spark, d):
    return ranking.token_idf(part_candidates(spark, d)).select("term", F.round("idf", 6).alias("idf"))


def words(text: str) -> str:
    return f"string_split({text}, ' ')"


RANKED = f"""WITH RECURSIVE parts AS (SELECT p_partkey, p_name, {NORMAL.format('p_name')} AS a, {NORMAL.format('p_brand')} AS b, {NORMAL.format('p_type')} AS t FROM part),
total AS (SELECT count(*)::DOUBLE AS n FROM parts),
common AS (SELECT token FROM (SELECT unnest({words("a || ' ' || b || ' ' || t")}) AS token FROM parts) WHERE length(token) > 2 AND NOT regexp_full_match(token, '[0-9]+') GROUP BY token HAVING count(*) >= (SELECT greatest(1, floor(n * 0.05)) FROM total)),
two AS (SELECT {words("a || ' ' || b")} AS w FROM parts),
terms AS (SELECT unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM two),
idf AS (SELECT term, ln((1 + (SELECT n FROM total)) / (1 + count(*))) + 1 AS idf FROM terms GROUP BY term HAVING count(*) <= 0.8 * (SELECT n FROM total)),
model AS (SELECT max(idf) AS top, quantile_cont(idf, 0.75) AS rare FROM idf),
c_names AS (SELECT p_partkey, unnest([a, b, t || ' ' || a, a || ' ' || t]) AS name FROM parts),
q_names AS (SELECT p_partkey, a || ' company' AS name FROM parts WHERE p_partkey % 100 = 0),
names AS (SELECT DISTINCT name FROM (SELECT name FROM c_names UNION ALL SELECT name FROM q_names)),
tokens AS (SELECT DISTINCT name, unnest({words('name')}) AS token FROM names),
weights AS (SELECT name, token, coalesce(idf, top) AS w, coalesce(idf, top) > rare AS is_rare FROM tokens LEFT JOIN idf ON term = token CROSS JOIN model),
whole AS (SELECT name, sum(w) AS w FROM weights GROUP BY name),
forms AS (SELECT name, array_to_string(list_sort({words('name')}), ' ') AS s, array_to_string(list_sort(list_filter({words('name')}, lambda x: length(x) > 1 AND NOT list_contains(every, x))), ' ') AS o FROM names CROSS JOIN (SELECT coalesce(list(token), []) AS every FROM common)),
shown AS (SELECT name, s, CASE WHEN (SELECT count(*) FROM common) = 0 THEN s ELSE o END AS o FROM forms),
pairs AS (SELECT q.name AS q, c.name AS c, q.s AS qs, c.s AS cs, q.o AS qo, c.o AS co FROM shown q, shown c WHERE q.name IN (SELECT name FROM q_names) AND c.name IN (SELECT name FROM c_names)),
texts AS (SELECT qs AS x, cs AS y FROM pairs UNION SELECT qo, co FROM pairs),
f AS (SELECT x, y, 0 AS i, list_transform(range(0, widest + 1), lambda z: 0) AS row FROM texts CROSS JOIN (SELECT max(length(y)) AS widest FROM texts) UNION ALL
SELECT x, y, i + 1, list_reduce(range(1, len(row)), lambda r, j: list_append(r, CASE WHEN substr(x, i + 1, 1) = substr(y, j, 1) THEN row[j] + 1 ELSE greatest(row[j + 1], r[j]) END), [0]) FROM f WHERE i < length(x)),
ratio AS (SELECT x, y, CASE WHEN length(x) + length(y) = 0 THEN 1.0 ELSE 2.0::DOUBLE * row[length(y) + 1] / (length(x) + length(y)) END AS r FROM f WHERE i = length(x)),
met AS (SELECT x.name AS q, y.name AS c, sum(x.w) AS w, sum(CASE WHEN x.is_rare THEN 1 ELSE 0 END) AS n_rare FROM weights x JOIN weights y USING (token) GROUP BY 1, 2),
scored AS (SELECT p.q, p.c, greatest(a.r, CASE WHEN p.qo = '' OR p.co = '' THEN 0 ELSE b.r END) AS letters, CASE WHEN m.w > 0 THEN least(1.0, m.w / (k.w + 0.3 * (e.w - m.w)) * power(1.3, m.n_rare)) END AS by_tokens
FROM pairs p JOIN ratio a ON a.x = p.qs AND a.y = p.cs JOIN ratio b ON b.x = p.qo AND b.y = p.co LEFT JOIN met m ON m.q = p.q AND m.c = p.c JOIN whole k ON k.name = p.q JOIN whole e ON e.name = p.c),
best AS (SELECT q, c, CASE WHEN by_tokens IS NULL THEN letters ELSE 0.7 * by_tokens + 0.3 * letters END AS s FROM scored),
of_part AS (SELECT b.q, n.p_partkey, max(b.s) AS s FROM best b JOIN c_names n ON n.name = b.c GROUP BY 1, 2),
final AS (SELECT n.p_partkey AS query_id, o.p_partkey, round(0.55 * o.s + CASE WHEN o.p_partkey % 100 = n.p_partkey % 100 THEN 0.15 ELSE 0 END, 12) AS s FROM q_names n JOIN of_part o ON o.q = n.name),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, p_partkey) AS position FROM final WHERE s > 0.1)
SELECT CAST(query_id AS VARCHAR) AS query_id, CAST(position AS INTEGER) AS position, CAST(placed.p_partkey AS VARCHAR) AS provider_id, p_name AS name, round(s, 6) AS similarity_score FROM placed JOIN parts ON parts.p_partkey = placed.p_partkey WHERE position <= 10"""


@query(RANKED)
def rank_topn(spark, d):
    return ranking.rank(part_queries(spark, d), part_candidates(spark, d)).select("query_id", "position", "provider_id", "name", F.round("similarity_score", 6).alias("similarity_score"))


@query("SELECT p_partkey, p_name FROM part WHERE p_name IS NOT NULL AND p_name <> '' AND p_partkey % 3 <> 0")
def valid_candidates(spark, d):
    made = table(spark, d, "part").select(F.expr("CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_partkey AS STRING) END").alias("provider_id"), F.col("p_name").alias("name"), "p_partkey", "p_name")
    return ranking.valid_candidates(made).select("p_partkey", "p_name")


# --- document types ---------------------------------------------------------------------------------------------------

TYPE_TEXT = "text || CASE doc_id % 6 WHEN 0 THEN ' Invoice No 7, bill to: subtotal, total amount, amount due' WHEN 1 THEN ' RECEIPT cashier qty change cash total merchant' WHEN 2 THEN ' passport nationality date of birth' WHEN 3 THEN ' W-2 wage tax year irs' ELSE '' END"
TYPE_SIZE, TYPE_PAGES, TYPE_TABLES = "n_chars * 40", "1 + doc_id % 4", "doc_id % 2 = 0"


def bonus_sql(kind: str) -> str:
    tests = {"small": f"{TYPE_SIZE} < 50000", "medium": f"{TYPE_SIZE} >= 50000 AND {TYPE_SIZE} < 100000", "large": f"{TYPE_SIZE} > 500000", "one_page": f"{TYPE_PAGES} = 1", "many_pages": f"{TYPE_PAGES} >= 3", "tables": TYPE_TABLES}
    return "".join(f" + CASE WHEN {tests[n]} THEN {b[kind]} ELSE 0 END" for n, b in doctype.BONUS.items() if kind in b)


DOC_TYPES = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {order} AS o, (0{''.join(f' + CASE WHEN contains(t, {chr(39)}{term}{chr(39)}) THEN {w} ELSE 0 END + CASE WHEN contains(source || {chr(39)} total{chr(39)}, {chr(39)}{term}{chr(39)}) THEN {w * 1.5} ELSE 0 END' for term, w in terms.items())}{bonus_sql(kind)})::DOUBLE AS score FROM b"
    for order, (kind, terms) in enumerate(doctype.INDICATORS.items())
)


@query(f"""WITH b AS (SELECT *, lower({TYPE_TEXT}) AS t FROM documents), s AS ({DOC_TYPES}),
r AS (SELECT *, row_number() OVER w AS rn, score - lead(score) OVER w AS gap FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY score DESC, o))
SELECT doc_id, kind AS top_type, score AS top_score, gap, CASE WHEN score >= 60 AND gap >= 15 THEN kind ELSE 'layout' END AS model FROM r WHERE rn = 1""")
def doc_type(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr(TYPE_TEXT).alias("text"), F.array(F.concat("source", F.lit(" total"))).alias("key_phrases"), F.expr(TYPE_SIZE).alias("file_size"), F.expr(TYPE_PAGES).alias("page_count"), F.expr(TYPE_TABLES).alias("has_tables"))
    return doctype.detect(docs)


# --- forensics --------------------------------------------------------------------------------------------------------

META = "map_from_arrays(array('CreationDate', 'ModDate', 'Producer'), array(concat('D:20', lpad(cast(doc_id % 30 as string), 2, '0')), concat('D:20', lpad(cast(doc_id % 20 as string), 2, '0')), concat('tool ', CASE WHEN doc_id % 5 = 0 THEN 'Adobe photoshop' ELSE source END)))"
PDF_RULES_SQL = """SELECT doc_id, list_filter([
 CASE WHEN 'D:20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') > 'D:20' || lpad(CAST(doc_id % 20 AS VARCHAR), 2, '0') THEN 'metadata: created after the last change' END,
 'metadata: missing Creator',
 CASE WHEN doc_id % 5 = 0 THEN 'metadata: written by the software Photoshop' END], lambda x: x IS NOT NULL) AS indicators FROM documents"""


def pdf_indicators(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", forensics.pdf_metadata_rules(F.expr(META)).alias("indicators"))


@query(f"SELECT doc_id, array_to_string(indicators, '; ') AS indicators FROM ({PDF_RULES_SQL})")
def pdf_metadata_rules(spark, d):
    return pdf_indicators(spark, d).select("doc_id", F.array_join("indicators", "; ").alias("indicators"))


IMAGE_META = "map_filter(map_from_arrays(array('EXIF DateTimeOriginal', 'Image DateTime', 'Image Make', 'Image Model', 'Image Software', 'EXIF ISOSpeedRatings', 'GPS GPSLatitude'), array('2020', cast(2020 + doc_id % 2 as string), CASE WHEN doc_id % 3 > 0 THEN 'Canon' END, CASE WHEN doc_id % 4 = 0 THEN 'EOS 5' ELSE 'Canon EOS' END, CASE WHEN doc_id % 7 = 0 THEN 'GIMP 2' END, cast(doc_id as string), CASE WHEN doc_id % 2 = 0 THEN '1' END)), (k, v) -> v IS NOT NULL)"


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 = 0 THEN 'metadata: missing Image Make' END, CASE WHEN doc_id % 2 = 1 THEN 'metadata: dates disagree' END, CASE WHEN doc_id % 7 = 0 THEN 'metadata: image edited by the software GIMP' END], lambda x: x IS NOT NULL), '; ') AS image,
array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'metadata: edited by the software GIMP' END, CASE WHEN doc_id % 2 = 0 THEN 'metadata: GPS is missing GPS GPSLongitude, GPS GPSLatitudeRef, GPS GPSLongitudeRef' END, CASE WHEN doc_id % 3 > 0 AND doc_id % 4 = 0 THEN 'metadata: make Canon and model EOS 5 disagree' END, CASE WHEN doc_id < 50 OR doc_id > 102400 THEN 'metadata: unusual ISO ' || CAST(doc_id AS VARCHAR) END], lambda x: x IS NOT NULL), '; ') AS camera FROM documents""")
def image_metadata_rules(spark, d):
    meta = F.expr(IMAGE_META)
    return table(spark, d, "documents").select("doc_id", F.array_join(forensics.image_metadata_rules(meta), "; ").alias("image"), F.array_join(forensics.camera_rules(meta), "; ").alias("camera"))


@query("SELECT doc_id, 5 + CAST(doc_id % 3 > 0 AS INTEGER) - 1 + CAST(doc_id % 7 = 0 AS INTEGER) + CAST(doc_id % 2 = 0 AS INTEGER) AS total_fields, TRUE AS has_creation_date, doc_id % 7 = 0 AS has_software_info, TRUE AS has_camera_info, doc_id % 2 = 0 AS has_gps_info FROM documents")
def metadata_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", forensics.metadata_summary(F.expr(IMAGE_META)).alias("s")).select("doc_id", "s.*")


PDF_BYTES = "concat('%PDF-1.', cast(doc_id % 8 as string), chr(10), '/Version /1.5 ', CASE WHEN doc_id % 3 = 0 THEN '/JavaScript (x) ' ELSE '' END, repeat('%%EOF', cast(doc_id % 3 as int)), ' /Filter /FlateDecode ', CASE WHEN doc_id % 4 = 0 THEN '/Filter [/LZWDecode]' ELSE '' END)"


@query("""SELECT doc_id, '1.' || CAST(doc_id % 8 AS VARCHAR) AS header_version, doc_id % 3 = 0 AS has_javascript, CAST(doc_id % 3 - 1 AS INTEGER) AS incremental_updates,
array_to_string(list_filter([CASE WHEN doc_id % 8 <> 5 THEN 'structure: header and catalogue versions differ' END, CASE WHEN doc_id % 3 = 0 THEN 'structure: holds JavaScript' END, CASE WHEN doc_id % 3 = 2 THEN 'structure: incremental updates: 1' END, CASE WHEN doc_id % 4 = 0 THEN 'structure: uncommon filters: /LZWDecode' END], lambda x: x IS NOT NULL), '; ') AS indicators FROM documents""")
def pdf_structure(spark, d):
    facts = table(spark, d, "documents").select("doc_id", forensics.pdf_facts(F.expr(PDF_BYTES).cast("binary")).alias("f"))
    return facts.select("doc_id", "f.header_version", "f.has_javascript", "f.incremental_updates", F.array_join(forensics.pdf_structure_rules(F.col("f")), "; ").alias("indicators"))


@query(f"""WITH i AS (SELECT doc_id, len(indicators) AS n FROM ({PDF_RULES_SQL})), s AS (SELECT doc_id, CAST(least(100, floor(n * 100 / 20)) AS INTEGER) AS risk_score, n AS total_issues FROM i)
SELECT doc_id, risk_score, CASE WHEN risk_score < 20 THEN 'Low' WHEN risk_score < 50 THEN 'Medium' WHEN risk_score < 80 THEN 'High' ELSE 'Very High' END AS risk_level, CAST(total_issues AS INTEGER) AS total_issues, risk_score >= 50 AS is_high_risk, total_issues > 0 AS has_metadata_issues, FALSE AS has_structure_issues FROM s""")
def risk_score(spark, d):
    return forensics.assess(pdf_indicators(spark, d)).select("doc_id", "risk_score", "risk_level", "total_issues", "is_high_risk", "has_metadata_issues", "has_structure_issues")


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), r AS (SELECT CASE WHEN least(100, 5 * n) < 20 THEN 'Low' WHEN least(100, 5 * n) < 50 THEN 'Medium' WHEN least(100, 5 * n) < 80 THEN 'High' ELSE 'Very High' END AS risk_level FROM s),
l AS (SELECT unnest(['Low', 'Medium', 'High', 'Very High']) AS risk_level) SELECT l.risk_level, count(r.risk_level) AS n FROM l LEFT JOIN r USING (risk_level) GROUP BY 1""")
def risk_distribution(spark, d):
    counted = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    return forensics.risk_distribution(counted.select(forensics.risk_level(forensics.risk_score(F.col("n"))).alias("risk_level")))


def category_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower({col}), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{name}'" for name, words in forensics.CATEGORIES.items()) + " ELSE 'metadata' END"


@query(f"SELECT {category_sql('text')} AS category, count(*) AS n FROM documents GROUP BY 1")
def issue_category(spark, d):
    return table(spark, d, "documents").groupBy(forensics.category(F.col("text")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT l_orderkey AS doc_id, l_shipmode AS font, count(*) AS n FROM (SELECT l_orderkey, l_returnflag || l_linestatus AS l_shipmode, l_linenumber FROM lineitem) WHERE l_linenumber <= 20 GROUP BY 1, 2)
SELECT doc_id, count(*) AS distinct_fonts, CASE WHEN count(*) > 3 THEN 'text: fonts: ' || CAST(count(*) AS VARCHAR) END AS indicator FROM f GROUP BY 1""")
def font_histogram(spark, d):
    chars = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.concat("l_returnflag", "l_linestatus").alias("font"))
    return forensics.font_rules(forensics.fonts(chars)).select("doc_id", "distinct_fonts", "indicator")


@query("""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, 'image: noise' AS issue FROM lineitem WHERE l_quantity > 20)
SELECT doc_id, CASE WHEN count(*) > 5 THEN 'image: issues on pages ' || array_to_string(list_transform(list_sort(list_distinct(list(page))), lambda x: CAST(x AS VARCHAR)), ', ') ELSE string_agg('Page ' || CAST(page AS VARCHAR) || ': ' || issue, '|' ORDER BY page) END AS indicators FROM p GROUP BY 1""")
def page_rollup(spark, d):
    issues = table(spark, d, "lineitem").filter("l_quantity > 20").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit("image: noise").alias("issue"))
    return forensics.page_rollup(issues).select("doc_id", F.array_join("indicators", "|").alias("indicators"))


@query("""WITH r AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE text <> '')
SELECT conv_id AS doc_id, count(*) AS pages_with_text, CAST(sum(length(text)) AS BIGINT) AS total_text_length, string_agg(CASE WHEN n <= 2 THEN left(text, 500) END, '|' ORDER BY turn) AS preview FROM r GROUP BY 1""")
def text_previews(spark, d):
    blocks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return forensics.previews(blocks).select("doc_id", "pages_with_text", F.col("total_text_length").cast("long").alias("total_text_length"), F.array_join(F.transform("text_blocks", lambda b: b["text"]), "|").alias("preview"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'pdf' WHEN page_id % 3 = 1 THEN 'image' END AS kind, md5(html) AS md5, sha256(html) AS sha256, CASE WHEN page_id % 2 = 0 THEN page_id % 4 = 0 END AS trusted FROM pages")
def file_digests(spark, d):
    path = F.expr("concat('/f/', page_id, CASE page_id % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' ELSE '.xyz' END)")
    found = table(spark, d, "pages").select("page_id", path.alias("path"), F.col("html").cast("binary").alias("content")).withColumn("length", F.octet_length("content").cast("long")).withColumn("modificationTime", F.lit(None).cast("timestamp"))
    known = F.expr("CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 4 = 0 THEN upper(sha2(content, 256)) ELSE 'x' END END")
    facts = files.described(found, known)
    page_id = F.regexp_extract("file_name", "^([0-9]+)", 1).cast("long").alias("page_id")
    return facts.select(page_id, forensics.kind_of(F.col("path")).alias("kind"), "md5", "sha256", F.col("matches_trusted_hash").alias("trusted"))


# --- structure, visuals, e-mail ---------------------------------------------------------------------------------------


@query("""SELECT doc_id, source AS page, sha256(text) AS sha256 FROM (SELECT *, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1""")
def content_hash_dedup(spark, d):
    visuals = table(spark, d, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.lit(0).alias("pos"), F.col("text").alias("content"))
    return structure.first_of_content(visuals).select(F.col("page").alias("doc_id"), F.col("doc_id").alias("page"), "sha256")


@query("""WITH p AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS page, l_quantity::INTEGER AS n_images FROM lineitem), s AS (SELECT *, coalesce(sum(n_images) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM p)
SELECT doc_id, string_agg('page body ' || CAST(page AS VARCHAR) || chr(10) || '--- PAGE BREAK ---' || chr(10), '' ORDER BY page) AS text, sum(n_images) >= 50 AS stopped FROM (SELECT doc_id, page, n_images FROM s WHERE so_far < 50) GROUP BY 1""")
def page_assembly(spark, d):
    page = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), page.alias("page"), F.col("l_quantity").cast("int").alias("n_images")).withColumn("text", F.concat(F.lit("page body "), F.col("page").cast("string")))
    made = structure.assemble(rows)
    return made.select("doc_id", F.replace("text", F.lit(structure.STOPPED), F.lit("")).alias("text"), F.contains("text", F.lit(structure.STOPPED)).alias("stopped"))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem) WHERE n <= 3")
def first_pages(spark, d):
    return forensics.first_pages(table(spark, d, "lineitem"), 3, "l_linenumber", "l_orderkey").select("l_orderkey", "l_linenumber")


def result_json(spark, d) -> DataFrame:
    """A document-analysis result per conversation: a page per turn, the roles as keys, a table of turns."""
    held = lambda col: F.struct(F.col(col).alias("content"))
    page = F.struct((F.col("turn") + 1).cast("int").alias("page_number"), F.lit(8.5).alias("width"), F.array(held("text")).alias("lines"))
    turn = F.struct(F.col("turn"), page.alias("page"), F.struct(held("role").alias("key"), held("text").alias("value")).alias("kv"))
    g = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    cell = lambda x: F.struct(x["kv"]["value"]["content"].alias("content"), x["turn"].cast("int").alias("row_index"), F.lit(0).alias("column_index"))
    tables = F.array(F.struct(F.transform("t", cell).alias("cells")))
    made = F.struct(F.transform("t", lambda x: x["page"]).alias("pages"), F.transform("t", lambda x: x["kv"]).alias("key_value_pairs"), tables.alias("tables"))
    return g.select("doc_id", F.to_json(made).alias("result"))


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page_number, 8.5::DOUBLE AS width, 0.0::DOUBLE AS height, text AS line FROM conversations")
def structure_pages(spark, d):
    return structure.pages(structure.parse(result_json(spark, d))).select("doc_id", "page_number", "width", "height", F.col("lines")[0].alias("line"))


@query("SELECT conv_id AS doc_id, role AS key, text AS value FROM conversations WHERE role IS NOT NULL AND role <> ''")
def structure_key_values(spark, d):
    return structure.key_values(structure.parse(result_json(spark, d)))


@query("SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS row_index, 0 AS column_index, 1 AS row_span, 'content' AS kind, coalesce(text, '') AS content FROM conversations")
def structure_cells(spark, d):
    return structure.cells(structure.parse(result_json(spark, d))).select("doc_id", "row_index", "column_index", "row_span", "kind", "content")


@query("""WITH g AS (SELECT conv_id AS doc_id, count(*) AS n, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1) SELECT doc_id, sha256(text) AS text_sha256, CAST(n AS INTEGER) AS page_count, TRUE AS has_tables FROM g""")
def structure_features(spark, d):
    return structure.features(structure.parse(result_json(spark, d))).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "page_count", "has_tables")


@query("""WITH p AS (SELECT l_orderkey AS doc_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT doc_id, 0 AS band, 0.0::DOUBLE AS top, 100.0::DOUBLE AS bottom, FALSE AS is_table FROM p UNION ALL SELECT doc_id, 1, 100.0, 100.0 + 10 * n, TRUE FROM p UNION ALL SELECT doc_id, 2, 100.0 + 10 * n, 800.0, FALSE FROM p""")
def page_bands(spark, d):
    p = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    rows = p.select("doc_id", F.lit(1).alias("page"), F.lit(800.0).alias("height"), F.array(F.struct(F.lit(100.0).alias("top"), (F.lit(100.0) + 10 * F.col("n")).alias("bottom"))).alias("tables"))
    return structure.bands(rows).select("doc_id", "band", "top", "bottom", "is_table")


ATTACHMENTS = f"SELECT l_orderkey AS email_id, l_linenumber AS pos, {NAME_SQL.format('l_linenumber')} AS filename, CAST(l_quantity AS BIGINT) % 5 AS size, l_linenumber % 4 = 0 AS is_embedded_email FROM lineitem"


def email_attachments(spark, d) -> DataFrame:
    a = F.struct(name_column("l_linenumber").alias("long_name"), F.lit(None).cast("string").alias("short_name"), F.lit(None).cast("string").alias("display_name"), (F.col("l_quantity").cast("long") % 5).alias("size"), (F.col("l_linenumber") % 4 == 0).alias("is_embedded_email"))
    mails = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("email_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", a.alias("a")))), lambda x: x["a"]).alias("attachments"))
    return email.attachments(mails)


@query(f"SELECT email_id, filename, size FROM ({ATTACHMENTS}) GROUP BY 1, 2, 3")
def attachment_dedup(spark, d):
    return email.first_of_each(email_attachments(spark, d)).select("email_id", "filename", "size")


@query(f"SELECT email_id, CAST(sum(CASE WHEN is_embedded_email THEN 0 ELSE 1 END) AS BIGINT) AS total, CAST(sum(CASE WHEN is_embedded_email THEN 1 ELSE 0 END) AS BIGINT) AS embedded, CAST(sum(CASE WHEN is_embedded_email THEN 0 ELSE size END) AS BIGINT) AS total_bytes FROM ({ATTACHMENTS}) GROUP BY 1")
def attachment_stats(spark, d):
    return email.stats(email_attachments(spark, d)).select("email_id", "total", "embedded", "total_bytes")


CLASHING = ["report.pdf", "report.pdf", "report_1.pdf", "notes", "report.pdf", "notes", "notes_1"]


@query(f"""WITH r AS (SELECT l_orderkey AS email_id, list({CLASHING}[(l_linenumber + l_orderkey) % 7 + 1] ORDER BY l_linenumber) AS names FROM lineitem GROUP BY 1),
t AS (SELECT email_id, list_reduce(names, lambda taken, x: list_append(taken, CASE WHEN NOT list_contains(taken, x) THEN x ELSE
 list_filter(list_transform(range(1, 100), lambda i: regexp_replace(x, '(\\.[^.]*)?$', '_' || i || '\\1')), lambda y: NOT list_contains(taken, y))[1] END), names[1:0]) AS paths FROM r)
SELECT email_id, unnest(range(0, len(paths))) AS pos, unnest(paths) AS path FROM t""")
def unique_names(spark, d):
    name = F.element_at(F.array(*map(F.lit, CLASHING)), ((F.col("l_linenumber") + F.col("l_orderkey")) % 7 + 1).cast("int"))
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("email_id"), pos.alias("pos"), name.alias("filename"))
    return email.unique_names(rows).select("email_id", F.col("pos").cast("long").alias("pos"), "path")


@query("""SELECT conv_id AS email_id, nullif(max(CASE WHEN turn = 0 THEN role END), '') AS sender, CAST(NULL AS VARCHAR) AS cc FROM conversations GROUP BY 1""")
def email_metadata(spark, d):
    mails = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("email_id")).agg(F.max(F.when(F.col("turn") == 0, F.col("role"))).alias("sender"), F.lit("").alias("cc"))
    return email.metadata(mails).select("email_id", "sender", "cc")


@query("""SELECT email_id, string_agg(t, '' ORDER BY pos) AS text FROM (SELECT conv_id AS email_id, -1 AS pos, coalesce(text, '') AS t FROM conversations WHERE turn = 0 UNION ALL SELECT conv_id, turn, chr(10) || '--- FROM ' || role || '.txt ---' || chr(10) || coalesce(text, '') FROM conversations WHERE turn > 0) GROUP BY 1""")
def email_report(spark, d):
    c = table(spark, d, "conversations").withColumnRenamed("conv_id", "email_id")
    return email.consolidate(c.filter("turn = 0").select("email_id", "text"), c.filter("turn > 0").select("email_id", F.col("turn").cast("int").alias("pos"), F.concat("role", F.lit(".txt")).alias("filename"), "text"))


# --- kernels ----------------------------------------------------------------------------------------------------------


@query("""SELECT vec_id, round(list_stddev_pop(m), 6) AS spread FROM (SELECT vec_id, list_transform(range(0, 4), lambda i: list_avg(list_slice(embedding, i * (len(embedding) // 4) + 1, (i + 1) * (len(embedding) // 4)))) AS m FROM embeddings)""")
def block_variance(spark, d):
    cell = F.size("embedding") / F.lit(4)
    part = lambda i: F.slice("embedding", (i * F.floor(cell) + 1).cast("int"), F.floor(cell).cast("int"))
    mean = lambda xs: F.aggregate(xs, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double")) / F.size(xs)
    means = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: mean(part(i)))
    held = table(spark, d, "embeddings").select("vec_id", means.alias("m")).withColumn("mu", mean(F.col("m")))
    return held.select("vec_id", F.round(F.sqrt(mean(F.transform("m", lambda x: (x - F.col("mu")) * (x - F.col("mu"))))), 6).alias("spread"))


@query()
def pixel_metrics(spark, d):
    """Kernels over an image made of each document's bytes: 32 wide, the last row filled up with zeros; null without a byte."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("b")).withColumn("h", F.ceil(F.octet_length("b") / 32).cast("int"))
    m = kernels.metrics(F.expr("CASE WHEN h > 0 THEN rpad(b, h * 32, X'00') END"), F.col("h"), F.lit(32), F.lit(1))
    names = ("noise_mean_spread", "ghost_ratio", "discontinuity_ratio", "shadow_spread")
    return docs.select("doc_id", m.alias("m")).select("doc_id", *[F.round(f"m.{n}", 6).alias(n) for n in names], F.array_join(forensics.pixel_rules(F.col("m")), "; ").alias("indicators"))


@query("""WITH d AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id, sqrt(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE) * (q.embedding[i]::DOUBLE - e.embedding[i]::DOUBLE)))) AS distance
FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS n FROM d),
g AS (SELECT query_id, max(CASE WHEN n = 1 THEN neighbor_id END) AS neighbor_id, max(CASE WHEN n = 1 THEN distance END) AS first, max(CASE WHEN n = 2 THEN distance END) AS second FROM r WHERE n <= 2 GROUP BY 1)
SELECT query_id, neighbor_id, round(first, 4) AS first, round(second, 4) AS second, first < 0.7 * second AS matches FROM g""")
def knn_ratio_match(spark, d):
    rows = table(spark, d, "embeddings")
    return neighbors.ratio_matches(rows.filter("vec_id % 100 = 0"), rows).select("query_id", "neighbor_id", F.round("first", 4).alias("first"), F.round("second", 4).alias("second"), "matches")


# --- schemas ----------------------------------------------------------------------------------------------------------

ORDER_SCHEMA = {
    "Order": {
        "class_description": "An order", "base_classes": ["BaseModel"],
        "fields": {
            "o_orderkey": {"type": "int", "required": True, "constraints": {"gt": 0, "multiple_of": 2}}, "o_totalprice": {"type": "float", "required": True, "constraints": {"ge": 1000, "le": 400000}},
            "o_orderpriority": {"type": "str", "required": False, "constraints": {"pattern": "^[12]-", "max_length": 8}}, "o_orderstatus": {"type": "Optional[str]", "required": False, "constraints": {"min_length": 1}},
        },
    }
}


@query(r"""SELECT o_orderkey, 'o_orderkey' AS field, 'multiple_of' AS rule FROM orders WHERE o_orderkey % 2 <> 0 UNION ALL SELECT o_orderkey, 'o_orderkey', 'gt' FROM orders WHERE o_orderkey <= 0 UNION ALL SELECT o_orderkey, 'o_totalprice', 'ge' FROM orders WHERE o_totalprice < 1000 UNION ALL
SELECT o_orderkey, 'o_totalprice', 'le' FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT o_orderkey, 'o_orderpriority', 'pattern' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[12]-') UNION ALL SELECT o_orderkey, 'o_orderpriority', 'max_length' FROM orders WHERE length(o_orderpriority) > 8 UNION ALL SELECT o_orderkey, 'o_orderstatus', 'min_length' FROM orders WHERE length(o_orderstatus) < 1""")
def constraint_violations(spark, d):
    return schema.violations(table(spark, d, "orders"), ORDER_SCHEMA, "Order", "o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey > 0 AND o_orderkey % 2 = 0 AND o_totalprice BETWEEN 1000 AND 400000 AND coalesce(regexp_matches(o_orderpriority, '^[12]-') AND length(o_orderpriority) <= 8, TRUE) AND coalesce(length(o_orderstatus) >= 1, TRUE)")
def constraint_filter(spark, d):
    return table(spark, d, "orders").filter(schema.all_valid(ORDER_SCHEMA, "Order")).select("o_orderkey")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
