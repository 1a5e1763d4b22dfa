import hashlib
import re

import pytest
from pyspark.sql import types as T

from lodestone.llm import chat

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("turns", T.IntegerType()), T.StructField("windows", T.StringType())])
NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\<|end|>", "<|turn|>user<|text|>", "<\\|end|>", "<<|", "<</SYS>>é\U0001f600", "$1 \\1", "", None, "<<SYS>>\n<s>"]
ROWS = (
    [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(NASTY)]
    + [(2, 0, "system", "Be kind. " * 5)] + [(2, i, ["assistant", "user"][i % 2], f"turn {i} é " * (i % 7 + 1)) for i in range(1, 40)]
    + [(3, 5, "assistant", "huge é " * 30_000), (3, 7, "assistant", "small"), (3, 6, None, "x\ny")]
    + [(4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (4, None, "user", "first")]
    + [(None, 0, "odd\nrole<|end|>", "t")]
)


def brute(rows, budget, history, reserve):
    """Windows as lists of (index, repeated)."""
    cost = [len((chat.TURN + esc(r) + chat.TEXT + esc(t) + chat.END).encode()) for r, t in rows]
    system = rows[0][0] == "system"
    out, start = [], 0
    while start < len(rows):
        room = budget if not start else max(1, budget - reserve - (cost[0] if system else 0))
        end = start + 1
        while end < len(rows) and sum(cost[start : end + 1]) <= room:
            end += 1
        again = [0] if system and start else []
        again += [i for i in range(int(system), start) if i >= start - history and sum(cost[i:start]) <= reserve]
        out.append((again, list(range(start, end))))
        start = end
    return out


def esc(t):
    t = t.replace("\\", "\\\\")
    for c in chat.CONTROL:
        t = t.replace(c, c[0] + "\\" + c[1:])
    return t


@pytest.mark.parametrize("budget,history,reserve", [(4096, 2, 1024), (240, 2, 120), (160, 5, 100), (1, 0, 0)])
def test_round_trip_windows_and_masks(spark, budget, history, reserve):
    df = spark.createDataFrame([(*r, 1, "w") for r in ROWS], SCHEMA)
    held = chat.format_conversations(df, budget, history, reserve)
    windows = {}
    for w in chat.windows_of(held).orderBy("conv_id", "window").collect():
        windows.setdefault(w.conv_id, []).append(w)
    got = {r.conv_id: r for r in chat.read_back(held).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        rows = [(r or "", t or "") for _, _, r, t in sorted((x for x in ROWS if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        loss = "".join(t for r, t in rows if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(rows)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        want = brute(rows, budget, history, reserve)
        assert r.n_windows == len(want)
        for w, (again, new) in zip(windows[conv], want, strict=True):
            body = "".join(chat.TURN + esc(rows[i][0]) + chat.TEXT + esc(rows[i][1]) + chat.END for i in again + new)
            assert w.formatted == chat.OPEN + body + chat.CLOSE and w.repeated == len(again)
            assert [re.sub(r"(?s)\\(.)", r"\1", w.formatted[s.start : s.end]) for s in w.loss_spans] == [rows[i][1] for i in new if rows[i][0] == "assistant"]
        assert r.formatted_chars == sum(len(w.formatted) for w in windows[conv])


def test_no_control_string_survives_in_texts(spark):
    df = spark.createDataFrame([(1, i, "user", t, 0, "") for i, t in enumerate(NASTY)], SCHEMA)
    text = chat.windows_of(chat.format_conversations(df)).first().formatted
    assert text.count("<|") == 3 * len(NASTY) and text.count("[INST]") == 0 and text.count("</s>") == 1 and text.count("<s>") == 1


def test_budgets_hold_in_tokens(spark):
    """Counts by the tokenizer itself, made from the rendered turns; and the upper bound without them."""
    import sentencepiece

    from lodestone.llm import subword

    sp = sentencepiece.SentencePieceProcessor(model_file=subword.MODEL)
    texts = [("é 漢 " * (i % 5) + f"some plain words of turn {i} " * (i % 9)) for i in range(60)]
    rows = [(9, i, ["user", "assistant"][i % 2], t, len(sp.encode(chat.TURN + ["user", "assistant"][i % 2] + chat.TEXT + t + chat.END)), "") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    size = {}
    for counts in ("turns", None):
        held = chat.windows_of(chat.format_conversations(df, 200, 2, 60, counts)).collect()
        assert all(len(sp.encode(w.formatted)) <= 200 + 8 or w.formatted.count(chat.TURN) == 1 + w.repeated for w in held)
        size[counts] = len(held)
    assert size["turns"] < size[None]  # real counts fill the windows better


def test_query_adds_its_conversation_and_empty_table(spark):
    got = chat.query(spark, "/root/testdata/sf0.001").filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (got.n_turns, got.loss_chars, got.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
