r"""Chat formatting in budgeted windows.

Template: a window is `<s>` turns `</s>`; a turn is `<|turn|>` role `<|text|>` text `<|end|>`. Control strings (those
and the other common ones in CONTROL) inside roles and texts get a backslash after their first character, and a
backslash is doubled, so that no text can open or end a turn; taking each backslash away gives the text again.

Windows: prefix sums of the turns' tokens choose turn-aligned spans. A span takes turns while the prefix sum stays
within the budget, less, after the first window, the system turn and the part reserved for history. A later window
repeats the system turn (the conversation's first) and up to `history` preceding turns that fit the reserve; what it
repeats is masked, so each assistant text is a target exactly once. A turn larger than a budget is a window of its own,
whole. Tokens of a turn are counted by the caller's tokenizer if a column with the counts is named (of the turn as
rendered); otherwise by an exact upper bound, its UTF-8 bytes as rendered, as no piece of a vocabulary with byte fallback
covers less than a byte. Either way a window of several turns holds no more tokens than the budget and its ends.

Rows of a conversation go by turn (ties: role, then text; repeated rows stay; null turns first). Null roles and texts
count as empty, an empty table gives an empty result, extra columns are not read. All of it is built-in functions; the
only shuffle brings the turns of a conversation together, whose digest is of the whole conversation: a conversation must
fit a row, and its windows are cut by folds over its turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

TURN, TEXT, END, OPEN, CLOSE = "<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>"
#: Strings that end or open something in this or another common template.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BUDGET, HISTORY, RESERVE = 4096, 2, 1024
TARGET_ROLE, SYSTEM_ROLE = "assistant", "system"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(turn: Column) -> Column:
    return F.concat(F.lit(TURN), turn["role"], F.lit(TEXT), turn["text"], F.lit(END))


def tokens(turn: Column) -> Column:
    """Those counted for a turn, else at most so many."""
    return F.coalesce(turn["counted"], F.octet_length(render(turn)).cast("long"))


def conversations_of(rows: DataFrame, counts: str | None = None) -> DataFrame:
    """conv_id, turns: array of (role, text, counted), escaped, in order, and the prefix sums of their tokens. counts: the
    column with the tokens of each turn."""
    counted = F.lit(None).cast("long") if counts is None else F.col(counts).cast("long")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), counted.alias("counted"))
    grouped = rows.select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), t["counted"].alias("counted")))
    sums = F.aggregate(
        F.transform("turns", tokens), F.array(F.lit(0).cast("long")),
        lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)),
    )
    return grouped.withColumn("turns", turns).withColumn("sums", sums)


def spans(budget: int, reserve: int) -> Column:
    """Starts of the windows: a turn opens one if the prefix sum at its end leaves the room counted from the last start."""
    upto = lambda i: F.element_at("sums", i + 1)  # noqa: E731  tokens of the first i turns
    system = F.when(F.col("has_system"), upto(F.lit(1))).otherwise(0)
    later = F.greatest(F.lit(budget - reserve) - system, F.lit(1))
    room = lambda start: F.when(start == 0, F.lit(budget)).otherwise(later)
    return F.aggregate(
        F.slice(F.transform("turns", lambda t, i: i), 2, F.greatest(F.size("turns"), F.lit(1))),
        F.array(F.lit(0)),
        lambda starts, i: F.when(upto(i + 1) - upto(F.element_at(starts, -1)) > room(F.element_at(starts, -1)), F.concat(starts, F.array(i))).otherwise(starts),
    )


def window(start: Column, end: Column, history: int, reserve: int) -> Column:
    """One window of turns start (from 0) to end (exclusive): repeated turns, then its own, with the spans under the loss."""
    upto = lambda i: F.element_at("sums", i + 1)
    first_free = F.when(F.col("has_system"), 1).otherwise(0)
    indices = F.transform("turns", lambda t, i: i)
    repeated = F.filter(indices, lambda i: (i < start) & (((i == 0) & F.col("has_system")) | ((i >= first_free) & (i >= start - history) & (upto(start) - upto(i) <= reserve))))
    shown = F.concat(F.transform(repeated, lambda i: F.struct(i.alias("i"), F.lit(True).alias("again"))), F.transform(F.filter(indices, lambda i: (i >= start) & (i < end)), lambda i: F.struct(i.alias("i"), F.lit(False).alias("again"))))
    turn = lambda x: F.element_at("turns", x["i"] + 1)
    text = F.concat(F.lit(OPEN), F.array_join(F.transform(shown, lambda x: render(turn(x))), ""), F.lit(CLOSE))
    marks = len(TURN) + len(TEXT)

    def add(state: Column, x: Column) -> Column:
        t = turn(x)
        begin = state["at"] + F.char_length(t["role"]) + marks
        stop = begin + F.char_length(t["text"])
        target = ~x["again"] & (t["role"] == TARGET_ROLE)
        return F.struct((stop + len(END)).alias("at"), F.when(target, F.concat(state["loss"], F.array(F.struct(begin.alias("start"), stop.alias("end"))))).otherwise(state["loss"]).alias("loss"))

    loss = F.aggregate(shown, F.struct(F.lit(len(OPEN)).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("loss")), add, lambda s: s["loss"])
    return F.struct(text.alias("formatted"), loss.alias("loss_spans"), F.size(repeated).alias("repeated"))


def format_conversations(rows: DataFrame, budget: int = BUDGET, history: int = HISTORY, reserve: int = RESERVE, counts: str | None = None) -> DataFrame:
    """conv_id and windows: array of (formatted, loss_spans in code points of formatted, repeated: its masked leading turns)."""
    held = conversations_of(rows, counts).withColumn("has_system", F.coalesce(F.element_at("turns", 1)["role"] == SYSTEM_ROLE, F.lit(False)))
    held = held.withColumn("starts", spans(budget, reserve))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("turns")))
    return held.withColumn("ends", ends).select("conv_id", F.transform(F.arrays_zip("starts", "ends"), lambda w: window(w["starts"], w["ends"], history, reserve)).alias("windows"))


def windows_of(formatted: DataFrame) -> DataFrame:
    """A row per window, as a trainer reads them."""
    return formatted.select("conv_id", F.posexplode("windows").alias("window", "w")).select("conv_id", "window", "w.*")


def read_back(formatted: DataFrame) -> DataFrame:
    """From the formatted windows alone: turns, text under the loss mask, and their digests."""
    def parse(w: Column) -> Column:
        pieces = F.slice(F.split(w["formatted"], r"<\|turn\|>"), w["repeated"] + 2, F.char_length(w["formatted"]))
        bodies = F.transform(pieces, lambda p: F.substring_index(p, END, 1))
        return F.transform(bodies, lambda b: F.struct(unescape(F.substring_index(b, TEXT, 1)).alias("role"), unescape(F.substring_index(b, TEXT, -1)).alias("text")))

    turns = F.flatten(F.transform("windows", parse))
    loss = F.array_join(F.flatten(F.transform("windows", lambda w: F.transform(w["loss_spans"], lambda s: unescape(F.substring(w["formatted"], s["start"] + 1, s["end"] - s["start"]))))), "")
    chars = F.aggregate("windows", F.lit(0).cast("long"), lambda n, w: n + F.char_length(w["formatted"]))
    out = formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), chars.alias("formatted_chars"), F.size("windows").cast("long").alias("n_windows"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    added = spark.sql(f"SELECT -7L AS conv_id, turn, role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    return read_back(format_conversations(given.unionByName(added)))


ORACLE = None  # SQL has no fold over turns; tested against brute force
