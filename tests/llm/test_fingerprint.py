import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash
from pyspark.sql import types as T

from lodestone.llm import fingerprint as fp

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.StringType()), T.StructField("fp", T.IntegerType())])


def signed(n):
    return n - (1 << 64) if n >> 63 else n


def h(value, seed=42):
    if isinstance(value, list):
        for v in value:
            seed = h(v, seed)
        return seed
    raw = value.encode() if isinstance(value, str) else struct.pack("<q", value)
    return xxhash.xxh64_intdigest(raw, seed & ((1 << 64) - 1))


def terms(text):
    return {signed(h(w)) for w in re.split(fp.TERM_BREAK, text.lower()) if w}


def short(values):
    return f"{h(values):016x}"[-fp.WIDTH :] if values else fp.EMPTY


def brute(text, known):
    t = sorted(x for x in terms(text) if x in known)
    out = short(t) if t else f"{h(text, h('text')):016x}"[-fp.WIDTH :]
    for i in range(fp.SUBSETS):
        kept = t
        for odds in fp.ODDS:
            kept = [x for x in kept if signed(h(x, xxhash.xxh64_intdigest(struct.pack('<i', i), 42))) % odds == 0]
            out += short(kept)
    return out


def like(a, b):
    if a == b:
        return 1.0
    w, levels = fp.WIDTH, len(fp.ODDS)
    parts = lambda x: [x[i : i + w] for i in range(w, len(x), w)]
    same = [p == q != fp.EMPTY for p, q in zip(parts(a), parts(b), strict=True)]
    return max(sum(same[k::levels]) for k in range(levels)) / fp.SUBSETS


@pytest.mark.parametrize("range_rows, quantiles", [(4096, 1024), (20, 1024), (20, 2)])
def test_against_brute_force(spark, monkeypatch, range_rows, quantiles):
    monkeypatch.setattr(fp, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(fp, "QUANTILES", quantiles)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id * 7 - 300, r.text) for r in real] + [(9001, None), (9002, ""), (9003, "a"), (9004, "the The THE " * 9000), (9005, real[0].text), (9006, "a"), (9006, "a"), (9006, "b"), (None, "no id")]
    got = fp.report(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    df = Counter(b for _, t in rows for b in terms(t or ""))
    known = {b for b, n in df.items() if fp.BAND[0] * len(rows) <= n <= fp.BAND[1] * len(rows)}
    order = sorted({(i, t or "") for i, t in rows}, key=lambda r: (-(fp.NO_ID if r[0] is None else r[0]), signed(h(r[1]))))
    want = {}
    for at, (i, t) in enumerate(order):
        n, follows = len(t), order[(at + 1) % len(order)][1]
        edited = t[: n - n // 3] + follows[: n // 3]
        a, b, c = brute(t, known), brute(edited, known), brute(follows, known)
        want[i, n, hashlib.sha256(edited.encode()).hexdigest()] = (a, b, like(a, b), like(a, c))
    for r in got:
        assert want[r.doc_id, r.n_chars, r.edited_sha256] == (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
    assert sum(r.near_edited for r in got) > 5 * sum(r.near_next for r in got)


def test_small_tables(spark):
    assert fp.report(spark.createDataFrame([], SCHEMA)).count() == 0
    r = fp.report(spark.createDataFrame([(1, "abc def", "", 0)], SCHEMA)).first()
    assert (r.near_next, r.edited_sha256) == (1.0, hashlib.sha256(b"abc dab").hexdigest())


@pytest.mark.parametrize("table_terms", [200_000, 0])
def test_terms_that_share_a_bucket_are_counted_apart(spark, monkeypatch, table_terms):
    """Of two terms whose hashes are equal modulo 2^18, one is in the band; it alone is in the fingerprint."""
    monkeypatch.setattr(fp, "LEXICON_TERMS", table_terms)
    seen = {}
    for i in range(10_000):
        a, b = seen.setdefault(h(f"w{i}") % (1 << 18), f"w{i}"), f"w{i}"
        if a != b:
            break
    rows = [(i, f"{b} only{i}" if i == 0 else f"{a} only{i}") for i in range(20)]  # 19 of 20 hold a, beyond the band
    got = {r.doc_id: r.fingerprint for r in fp.report(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    every = {x for _, t in rows for x in terms(t)} - {signed(h(a))}
    assert got == {i: brute(t, every) for i, t in rows}


@pytest.mark.parametrize("n", [0, 1, 3, 1000])
def test_table_has_each_term_in_its_list(spark, n):
    all_terms = [signed(h(f"w{i}")) for i in range(n)]
    lists = max(1, n)
    table = fp.table_of(spark.createDataFrame([(t,) for t in all_terms], "term long"), lists).first()[0]
    assert len(table) == lists and sorted(t for x in table for t in x) == sorted(all_terms) and all(t in table[t % lists] for t in all_terms)
