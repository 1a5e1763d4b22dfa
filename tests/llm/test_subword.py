from collections import Counter

import numpy as np
import pytest
from pyspark.sql import types as T

from lodestone.llm import subword

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("sample", T.IntegerType())])
TEXTS = [None, "", " ", "  two  spaces ", "the thing\nof\r\n\tthings", "▁literal ▁▁ mark", "日本語 \U0001f600 ħ", "word " * 20_000, "x" * 3000, "don't=\"q8Zk\" 0x1f", "a"]


@pytest.fixture(scope="module")
def vocabulary():
    return subword.Vocabulary.load()


@pytest.fixture(scope="module")
def trie(vocabulary):
    return subword.Trie.build(vocabulary)


def segmentations(text, vocabulary):
    """All of them with their log-probabilities, for text without unknown characters or inner spaces."""
    ids = {p: i for i, p in enumerate(vocabulary.pieces) if np.isfinite(vocabulary.log_probs[i])}
    whole = "▁" + text

    def go(at):
        if at == len(whole):
            yield (), 0.0
        for end in range(at + 1, len(whole) + 1):
            if (i := ids.get(whole[at:end])) is not None:
                for rest, p in go(end):
                    yield (i, *rest), p + vocabulary.log_probs[i]

    found = dict(go(0))
    total = np.log(sum(np.exp(p) for p in found.values()))
    return {s: p - total for s, p in found.items()}


def draw(text, n, k, trie, vocabulary):
    keys = np.array([subword.row_key(i, 3) for i in range(n)], np.uint64)
    out = [[] for _ in range(n)]
    with np.errstate(all="ignore"):
        for docs, ids, ends, log_p, level, inclusion in subword.sample_block([text] * n, keys, trie, vocabulary, k):
            for d, part, p, g, q in zip(docs, np.split(ids, ends[:-1]), log_p, level, inclusion, strict=True):
                out[d].append((tuple(part.tolist()), p, g, q))
    return out


def test_samples_follow_the_law_of_draws_without_replacement(vocabulary, trie):
    want = segmentations("ther", vocabulary)
    n = 20_000
    got = draw("ther", n, 3, trie, vocabulary)
    assert all(len({s for s, *_ in row}) == 3 and all(abs(p - want[s]) < 1e-9 for s, p, *_ in row) and row[0][2] > row[1][2] > row[2][2] for row in got)
    first, pairs = Counter(r[0][0] for r in got), Counter((r[0][0], r[1][0]) for r in got)
    for s, p in sorted(want.items(), key=lambda x: -x[1])[:6]:
        assert abs(first[s] / n - np.exp(p)) < 4 * np.sqrt(np.exp(p) / n) + 1e-4
        for t, q in sorted(want.items(), key=lambda x: -x[1])[:6]:
            if s != t:
                odds = np.exp(p) * np.exp(q) / (1 - np.exp(p))
                assert abs(pairs[s, t] / n - odds) < 4 * np.sqrt(odds / n) + 1e-4
    weight = np.array([sum(np.exp(p - q) for _, p, _, q in r) for r in got])
    assert abs(weight.mean() - 1) < 5 * weight.std() / np.sqrt(n)


def test_all_segmentations_come_when_k_exceeds_them(vocabulary, trie):
    for text in ("a", "of", "xq"):
        want = segmentations(text, vocabulary)
        for row in draw(text, 20, len(want) + 3, trie, vocabulary):
            assert {s for s, *_ in row} == set(want) and len(row) == len(want)
            assert all(q == 0 for *_, q in row)


@pytest.mark.parametrize("k", [1, 3])
def test_round_trip_of_whole_texts(spark, k):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 1), (None, "no id", "x", 1)]
    got = subword.encode(spark.createDataFrame(rows, SCHEMA), k=k, check=True)
    seen = Counter()
    texts = subword.decode(got).collect()
    for r in texts:
        assert r.exact and r.text == (("no id" if r.doc_id is None else TEXTS[r.doc_id]) or "")
        seen[r.doc_id] += 1
    assert seen[0] == seen[1] == 1 and seen[7] == k and seen[3] == 2 * k
    again = subword.encode(spark.createDataFrame(rows, SCHEMA).repartition(5), k=k)
    key = lambda r: (str(r.doc_id), r.sample, r.ids, r.log_prob, r.perturbed)
    assert sorted(map(key, texts)) == sorted(map(key, again.collect()))


def test_cuts_change_no_law(vocabulary, trie, monkeypatch):
    """With every word cut where it can be, samples and their log-probabilities are those of the whole word's lattice."""
    text = "th\ner\u4e00of"
    assert trie.classes[ord("\n")] == 0 or len(subword.cut([" " + text], trie)[0]) > 2
    whole = draw(text, 2000, 2, trie, vocabulary)
    monkeypatch.setattr(subword, "LONG_WORD", 0)
    monkeypatch.setattr(subword, "CUT_CHARS", 3)
    parts = draw(text, 2000, 2, trie, vocabulary)
    law = {s: p for row in whole for s, p, *_ in row}
    assert len(subword.cut([" " + text], trie)[0]) > 2 and "".join(subword.cut([" " + text], trie)[0]) == " " + text
    assert all(abs(p - law.get(s, p)) < 1e-9 for row in parts for s, p, *_ in row)
    first = [Counter(row[0][0] for row in x) for x in (whole, parts)]
    for s, n in first[0].most_common(5):
        assert abs(n - first[1][s]) < 6 * np.sqrt(n)
    for text in ("ther", "other", " a  thing"):
        assert [len(x) for x in subword.cut([" " + w for w in text.split(" ")], trie)] == [1] * len(text.split(" ")) or "".join(sum(subword.cut([" " + w for w in text.split(" ")], trie), [])) == " " + text


def test_texts_without_spaces_cost_what_others_do(spark, vocabulary, trie):
    import time

    r = np.random.default_rng(0)
    words = ["".join(chr(97 + c) for c in r.integers(0, 26, 1 + r.integers(0, 9))) for _ in range(20_000)]
    texts = {"spaces": " ".join(words), "lines": "\n".join(words), "tabs": "\t".join(words), "han": "".join(chr(c) for c in r.integers(0x4E00, 0x9FA5, 100_000)), "one word": "".join(chr(97 + c) for c in r.integers(0, 26, 1_000_000))}
    plain, keys = (vocabulary.plain(), trie.plain()), ["doc_id", "text"]
    speed = {}
    for name, text in texts.items():
        batch = subword.pa.RecordBatch.from_arrays([subword.pa.array([1]), subword.pa.array([text])], names=keys)
        began = time.perf_counter()
        out = list(subword.encode_batches([batch], plain, 2, 7, True))
        speed[name] = len(text) / (time.perf_counter() - began)
        assert len(out) == 1 + (name != "han") and all(x.column("exact").to_pylist() == [True] for x in out)  # bytes alone have one segmentation
    print(speed)
    assert min(speed.values()) > 0.2 * speed["spaces"], speed  # half, and room for a busy machine


def test_long_samples_differ_and_empty_table(spark):
    got = subword.encode(spark.createDataFrame([(1, TEXTS[7], "", 1)], SCHEMA), k=3).collect()
    assert len({tuple(r.ids) for r in got}) == 3 and np.isfinite([r.log_inclusion for r in got]).all()
    assert subword.encode(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unknown_pieces_are_bytes_and_pieces_stay_within_words(vocabulary, trie):
    (row,) = draw("日\n of", 1, 1, trie, vocabulary)
    pieces = [vocabulary.pieces[i] for i in row[0][0]]
    assert "<0x0A>" in pieces and not any(p != "▁" and "▁" in p[1:] for p in pieces)


def test_agenda_looks_no_further_than_needed(vocabulary, trie, monkeypatch):
    """Steps far behind the first ones cannot reach the k-th value: they are not looked at, and how many are looked at first changes nothing."""
    r, looked, steps = np.random.default_rng(0), [], []
    text = " ".join("".join(chr(97 + c) for c in r.integers(0, 26, 5)) for _ in range(4000))
    values = subword.agenda_values

    def counted(path, *others):
        out = values(path, *others)
        looked.append(len(out[0]))
        steps.append(len(path.word))
        return out

    monkeypatch.setattr(subword, "agenda_values", counted)
    got = draw(text, 2, 3, trie, vocabulary)
    assert sum(looked) < 0.5 * 3 * max(steps)
    for window in (1, 1 << 40):
        monkeypatch.setattr(subword, "WINDOW", window)
        assert draw(text, 2, 3, trie, vocabulary) == got


def test_words_of_all_lengths_share_a_lattice(vocabulary, trie, monkeypatch):
    """Sums over words of mixed lengths, with long pieces, few words at the last places or many, give each word's own law."""
    words = ["a", "of", "xq", "ther", "there", "information", "understand", "of", "----", "________"]
    texts = words * 30 + ["", "of"]
    results = []
    for few in (subword.FEW, 0, 1 << 20):
        monkeypatch.setattr(subword, "FEW", few)
        keys = np.array([subword.row_key(i, 3) for i in range(len(texts))], np.uint64)
        with np.errstate(all="ignore"):
            results.append([[x.tolist() for x in part] for part in subword.sample_block(texts, keys, trie, vocabulary, 2)])
    assert results[0] == results[1] == results[2]
    law = {w: segmentations(w, vocabulary) for w in set(words)}
    assert max(len(vocabulary.pieces[i]) for w in law for s in law[w] for i in s) > subword.NARROW
    for docs, ids, ends, log_p, *_ in results[0]:
        for d, part, p in zip(docs, np.split(ids, ends[:-1]), log_p, strict=True):
            assert texts[d] == "" or abs(law[texts[d]][tuple(part.tolist())] - p) < 1e-9


def test_surrogates_and_words_in_order(vocabulary):
    words, kind, count = subword.words_of(["b a  b", "", "a\n \ud800", " "])
    assert words == ["b", "a", "", "a\n", "\ud800"] and kind.tolist() == [0, 1, 2, 0, 3, 4, 2, 2] and count.tolist() == [4, 0, 2, 2]
