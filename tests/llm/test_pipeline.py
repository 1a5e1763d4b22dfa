from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from lodestone.llm import mixing, pipeline, quality, subword
from lodestone.llm.common import keep

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = text.translate(LOWER).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def brute(spark):
    """Ids after each filtering stage, plainly; the classifier's own scores are taken as they are."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r.doc_id: r for r in quality.scored(docs, model).collect()}
    known = quality.WordFeatures()
    good = {i for i, r in rows.items() if not model.tails(quality.np.array([model.margin(r.text, known)])).size or model.tails(quality.np.array([model.margin(r.text, known)]))[0, -1] >= 0.5}
    last = {}
    for i in sorted(good):
        last[rows[i].text.translate(LOWER)] = i
    exact = set(last.values())
    order, root = sorted(exact), {i: i for i in exact}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(rows[i].text) for i in order}
    for a in order:
        for b in order:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return rows, good, exact, {i for i in order if find(i) == i}


def test_stages(spark, brute):
    rows, *kept = brute
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (_, stage), want in zip(corpus_pipeline.STAGES[:3], kept, strict=True):
        got = stage(spark, docs, SF)
        assert got.columns == COLUMNS
        docs = keep(got, "test")
        assert sorted(r.doc_id for r in docs.collect()) == sorted(want)
    mixed = keep(pipeline.source_mixing(spark, docs, SF), "test")
    assert mixed.columns == COLUMNS
    taken = Counter(r.doc_id for r in mixed.collect())
    assert set(taken) <= kept[-1] and max(taken.values()) <= 3
    size = {i: len(rows[i].text.encode().split()) for i in kept[-1]}
    by_source, words = defaultdict(int), defaultdict(int)
    for i in kept[-1]:
        by_source[rows[i].source] += size[i]
        words[rows[i].source] += size[i] * taken[i]
    target = {r.source_size: r.target for r in mixing.report(docs).collect()}
    for s, n in by_source.items():
        assert abs(words[s] - target[n]) <= max(size[i] for i in kept[-1] if rows[i].source == s)
    encoded = pipeline.sentencepiece_encoding(spark, mixed, SF)
    decoded = Counter((r.doc_id, r.sample) for r in subword.decode(encoded).collect() if r.text == rows[r.doc_id].text)
    assert decoded == Counter({(i, s): n for i, n in taken.items() for s in range(2)})


def test_run_gives_the_last_stage(spark, brute):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns[:3] == ["doc_id", "sample", "ids"] and {r.doc_id for r in got.select("doc_id").collect()} <= brute[-1]


def test_last_stage_decodes_what_it_encodes(spark):
    docs = spark.createDataFrame([(1, "Some words, é and 漢字."), (2, ""), (3, None)], "doc_id long, text string")
    got = pipeline.sentencepiece_encoding(spark, docs, SF).collect()
    assert {r.doc_id for r in got} == {1, 2, 3} and all(r.exact is True for r in got)


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, taken string, ids int, `component_id` string"


def test_odd_rows_and_extra_columns(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and columns with names that stages use themselves."""
    long = " ".join(f"word{i % 5000} more{i}" for i in range(60_000))
    texts = ["Plain words here, a sentence of some length.", long, long + " end", "", None, " \n", "x" * 50_000, "PLAIN words here, a sentence of some length."]
    rows = [(i, t, "en", "web", 1, "t", i, None) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (50, "only one", None, None, None, None, None, None), (None, "no identifier at all", "en", None, 1, "t", 1, "c")]
    spark.createDataFrame(rows, EXTRA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, None), (10**6, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = keep(stage(spark, docs, str(tmp_path)), "test")
        assert docs.schema.names == [f.name for f in spark.read.parquet(f"{tmp_path}/documents.parquet").schema], name
        kept.append(Counter(r.doc_id for r in docs.collect()))
    assert kept[0] == Counter(r[0] for r in rows)  # no labels of these documents: all stay
    assert kept[1] == Counter([1, 2, 4, 5, 6, 7, 50, None])  # 0 equals 7, 3 equals 4
    assert set(kept[2]) == {1, 4, 5, 6, 7, 50, None}  # 2 is nearly 1
    assert set(kept[3]) <= {1, 6, 7, 50, None} and 1 in kept[3]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(kept[3]) and all(r.exact for r in got)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], EXTRA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
