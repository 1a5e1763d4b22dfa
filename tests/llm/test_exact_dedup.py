import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import types as T

from lodestone.llm import exact_dedup

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("row", T.IntegerType())])
TABLE = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ROWS = [(1, "Abc É", "x", 1), (2, "aBC É", None, 2), (3, "abc é", "y", 3), (4, None, "z", 4), (5, "", "z", 5), (6, "long " * 20_000, "", 6), (7, "b", "", 7), (7, "b", "", 8), (8, "B", "", 9), (8, "B", "", 10)]


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(TABLE)].append(doc_id)
    return groups


@pytest.mark.parametrize("digest_bytes", [32, 1, 0])
def test_report_matches_brute_force_even_when_digests_collide(spark, digest_bytes):
    got = exact_dedup.report(spark.createDataFrame(ROWS, SCHEMA), digest_bytes).collect()
    want = brute(ROWS)
    norm = {r[0]: (r[1] or "").translate(TABLE) for r in ROWS}
    assert len(got) == len(ROWS)
    for r in got:
        group = want[norm[r.doc_id]]
        assert (r.keep_id, r.group_size) == (max(group), len(group))
        if digest_bytes == 32:
            assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    assert sum(r.kept for r in got) == len(want)


def test_deduplicate_keeps_columns_and_one_row_of_repeated_rows(spark):
    got = exact_dedup.deduplicate(spark.createDataFrame(ROWS, SCHEMA))
    assert got.columns == ["doc_id", "text", "digest", "row"]
    assert sorted(r.doc_id for r in got.collect()) == [2, 3, 5, 6, 8]


def test_empty_table_and_null_ids(spark):
    assert exact_dedup.report(spark.createDataFrame([], SCHEMA)).count() == 0
    got = exact_dedup.report(spark.createDataFrame([(None, "a", "", 1), (None, "A", "", 2), (3, "c", "", 3)], SCHEMA)).collect()
    assert sorted((r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is None) == [(None, 2, False), (None, 2, True)]


def test_state_continues_over_later_files(spark, tmp_path):
    landing, checkpoint = f"{tmp_path}/landing", f"{tmp_path}/state"
    for ids in ([1, 2], [3]):
        docs = spark.createDataFrame([(i, "same", "", i) for i in ids], SCHEMA)
        exact_dedup.land(exact_dedup.located(docs), landing)
        state = exact_dedup.advance(spark, landing, checkpoint).collect()
    assert [(r.keeper.doc_id, r.group_size) for r in state] == [(3, 3)]


def test_inputs_that_repeat_rows_of_a_file(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "B")], "doc_id long, text string").write.parquet(f"{tmp_path}/t")
    twice = spark.read.parquet(f"{tmp_path}/t").selectExpr("doc_id", "explode(array(text, text, lower(text))) AS text")
    assert sorted(exact_dedup.deduplicate(twice).toPandas()["text"].str.lower()) == ["a", "b"]
    direct = spark.read.parquet(f"{tmp_path}/t").filter("doc_id > 0")
    assert exact_dedup.located(direct).inputFiles() == direct.inputFiles()
