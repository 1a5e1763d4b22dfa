"""The engine as tasks over tables and as functions in SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.adapters import plugs
from lodestone.functions.similarity import indel_ratio
from lodestone.operators import doctype, email, forensics, pii, ranking, structure


def anonymize_text(docs: DataFrame, **options) -> DataFrame:
    """doc_id, anonymised text, entities and lengths."""
    return pii.anonymize(docs, **options)


def provider_ranking(queries: DataFrame, candidates: DataFrame, top_n: int = ranking.TOP_N, common_share: float = 0.10) -> DataFrame:
    """Answers as rows: query_id, total_candidates, matches."""
    return ranking.response(ranking.rank(queries, candidates, top_n, common_share), candidates)


def email_preprocessing(files: DataFrame) -> DataFrame:
    """Rows of .msg files: the fields and attachments that the parser finds, or an error."""
    good = email.messages(files).filter("error IS NULL")
    return plugs.map_files(good, plugs.msg_rows, f"{plugs.MSG_SCHEMA}, attachments {plugs.ATTACHMENT}")


def email_report(emails: DataFrame, read: Callable[[DataFrame], DataFrame], config: dict[str, dict] | None = None, entities: list[str] | None = None) -> DataFrame:
    """email_id, text, anonymised, entities: bodies with the texts of their attachments under headers, then anonymised.

    emails: email_id, body, attachments (with content). read gets the attachments that are files to read (email_id, pos,
    filename, route, content), each once per name and size, and gives their texts (email_id, pos, filename, text)."""
    rows = email.attachments(emails).join(emails.select("email_id", F.posexplode("attachments").alias("pos", "a")).select("email_id", "pos", F.col("a.content").alias("content")), ["email_id", "pos"])
    own = email.first_of_each(rows.filter(~F.col("is_embedded_email")))
    texts = read(own.withColumn("route", email.route(F.col("filename"))).filter("route <> 'none'").select("email_id", "pos", "filename", "route", "content"))
    whole = email.consolidate(emails.select("email_id", F.col("body").alias("text")), texts)
    return pii.anonymize(whole, config, entities).select("email_id", "text", "anonymised", "entities")


def forensic_analysis(files: DataFrame, config: forensics.Config = forensics.Config()) -> DataFrame:
    """One assessed row per file; files that cannot be analysed say so and stop nothing. The configuration's thresholds
    hold where the rows have pixel metrics (column metrics)."""
    done = forensics.analyze(files)
    if "metrics" not in files.columns:
        return done
    more = F.concat("indicators", forensics.pixel_rules(F.col("metrics"), config))
    plain = [c for c in done.columns if not (c.endswith("_issues") or c.startswith("risk_") or c in ("is_high_risk", "indicators"))]
    return forensics.assess(done.select(*plain, more.alias("indicators")))


def extract_text(results: DataFrame, second_pass: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Choose the model of each document from its first-pass result: forced_model wins, then the detected one if
    auto_detect, else layout. results: doc_id, result (JSON), file_size, forced_model, auto_detect. The second pass, if
    given, gets the rows with their model and gives final results; documents with a forced model need no first pass."""
    parsed = structure.parse(results)
    found = structure.features(parsed).join(results.select("doc_id", "file_size"), "doc_id")
    detected = doctype.detect(found).select("doc_id", F.col("model").alias("detected"))
    chosen = doctype.choose_model(F.col("forced_model"), F.col("auto_detect"), F.col("detected"))
    rows = parsed.join(detected, "doc_id", "left").withColumn("model", chosen).withColumn("model_id", doctype.model_id(F.col("model")))
    return second_pass(rows) if second_pass else rows


def remote_results(files: DataFrame, make_client: Callable[[], Callable[[bytes, str], str]], model: str = "layout") -> DataFrame:
    """path, result (JSON), error: what a document client gives for each file; the client is made once per task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    out.append((path, client(bytes(content), model), None))
                except Exception as e:  # noqa: BLE001 - one bad file is a row, not the end of the job
                    out.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "result", "error"])

    return files.filter(doctype.readable(F.col("path"))).select("path", "content").mapInPandas(run, "path string, result string, error string")


def candidates_of(candidates: DataFrame, country: str | None = None) -> DataFrame:
    """Candidates of a country, or all."""
    return candidates if country is None else candidates.filter(F.lower("country") == country.lower())


class Spans:
    """UDTF: the spans of a text."""

    def eval(self, text: str):
        yield from ((e, text[a:b], a, b, s) for e, a, b, s in pii.find_spans(text, list(pii.ENTITIES)))


def register(spark: SparkSession) -> None:
    """indel_ratio(a, b), keyword_pass(text) and the table function pii_spans(text) in SQL."""
    spark.udf.register("indel_ratio", indel_ratio)
    spark.udf.register("keyword_pass", keyword_udf())
    spark.udtf.register("pii_spans", F.udtf(Spans, returnType=pii.SPAN))


def keyword_udf():
    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else pii.keyword_pass(t))

    return run
