"""Secret scans by assignment-aware lexing.

Base patterns find assigned credentials, access keys and long hexadecimal runs. The lexer then reads source and
configuration syntax: around each of = : := => it takes the name on the left (bare or quoted, dotted, with the words of
snake, kebab or camel case) and the value on the right (quoted literals with escapes, of one or three quotes, joined by +;
bare words; lines further in below `name:` or `name: |`; references like NAME, $NAME, ${NAME}). A type between name and
value is passed over, and of a pair of attributes key="name" value="..." the value belongs to the name. Constants
propagate: a reference passes on the literals of the last assignment to its name before it, or of the first one after,
however many steps and round any cycle, so `base = "x7..."` is found when `db.password = base` follows or precedes. A literal's score is the weight
of the most sensitive target name it reaches plus what its shape adds (length, entropy of its characters, mixed
classes); literals that reach LEAST are spans of kind `lexed`, unless a base span covers them. Placeholders are no
secrets.

Spans are code points, end exclusive. Whole texts are read; null counts as empty; no text gives no span; an empty table
gives an empty result. Extra columns are not read. Repeated rows give repeated rows. Matching is linear in the text.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs, as long ones alone pass
LEAST, SHORTEST = 3.0, 8
#: What a target name's words weigh.
NAME_WEIGHTS = {
    "password": 2.5, "passwd": 2.5, "passphrase": 2.5, "pwd": 2.5, "secret": 2.5, "token": 2.0, "apikey": 2.5, "credential": 2.0, "credentials": 2.0,
    "key": 1.0, "auth": 1.0, "private": 1.0, "access": 0.5, "api": 1.0, "client": 0.5, "signing": 1.0, "encryption": 1.0, "pass": 2.0, "pw": 2.0,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|.*(?:example|changeme|change_me|placeholder|your[_-]|dummy|redacted).*|none|null|true|false|undefined)$")
OPERATOR = re.compile(r":=|=>|[=:]")
BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]+""")
BRACED = re.compile(r"\$\{([A-Za-z_][\w.]*)[^}\n]*\}", re.ASCII)
#: What ends or hides the end of a literal, by its quotes.
STOPS = {mark: re.compile(r"\\.|\n|" + mark) for mark in "\"'"} | {mark: re.compile(r"\\.|" + mark, re.DOTALL) for mark in ("`", '"""', "'''")}
INDENT, BLOCK, LINE = re.compile(r"[ \t]*"), re.compile(r"[ \t]*([|>][+-]?)?[ \t]*\n"), re.compile(r"([ \t]*)([^\n]*?)[ \t\r]*(?:\n|\Z)")
ANNOTATION = re.compile(r"[ \t]*[A-Za-z_][\w.]*(?:\[[\w.\[\], |]*\]|<[\w.<>, |]*>)?\??(?:[ \t]*\|[ \t]*[A-Za-z_][\w.]*)*[ \t]*", re.ASCII)
#: Attributes that name a setting and that hold its value, and what may lie between them.
KEY_WORDS, VALUE_WORDS = {"key", "name", "id", "property", "setting"}, {"value", "val", "content"}
BETWEEN = re.compile(r"[^<>{}\n]*\n?[^<>{}\n]*")
REFERENCE = re.compile(r"\$([A-Za-z_][\w.]*)|([A-Za-z_][\w.]*)", re.ASCII)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    joined = "".join(words)
    return min(3.0, max([NAME_WEIGHTS.get(joined, 0.0), sum(NAME_WEIGHTS.get(w, 0.0) for w in set(words))]))


def literal_score(value: str) -> float:
    if len(value) < SHORTEST or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return -9.0
    counts = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    classes = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, len(value) / 32) + max(0.0, bits - 2.5) / 2 + 0.25 * (classes - 1)


def name_before(text: str, at: int) -> str:
    """The name that ends just before an operator; '' if there is none."""
    i = at
    while i and text[i - 1] in " \t":
        i -= 1
    quote = text[i - 1] if i and text[i - 1] in "\"'" else ""
    i -= len(quote)
    j = i
    while j and text[j - 1] in NAME_CHARS:
        j -= 1
    if quote and (not j or text[j - 1] != quote):
        return ""
    return text[j:i].strip(".-")


def closing(text: str, at: int) -> tuple[int, int]:
    """Of a quoted literal that opens here: where it ends and where its quotes end; escapes hide quotes, one line unless
    the quotes are threefold or backticks. (-1, -1) if nothing closes it."""
    mark = text[at : at + 3] if text[at : at + 3] in ('"""', "'''") else text[at]
    end = at + len(mark)
    while m := STOPS[mark].search(text, end):
        if m.group() == mark:
            return m.start(), m.end()
        if m.group() == "\n":
            break
        end = m.end()
    return -1, -1


def indent(text: str, at: int) -> int:
    """Columns of space that open the line of this place."""
    start = text.rfind("\n", 0, at) + 1
    return INDENT.match(text, start).end() - start


def lines_below(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Literals of a key whose value is on the next lines, further in: all lines after | or >, else one."""
    m = BLOCK.match(text, at)
    if not m:
        return [], at
    depth, literals, at = indent(text, at), [], m.end()
    while m_line := LINE.match(text, at):
        deeper = m_line.end(1) - m_line.start(1) > depth and m_line.end(2) > m_line.start(2)
        if not deeper or not m.group(1) and (OPERATOR.search(m_line.group(2)) or m_line.group(2)[0] in "-#\"'"):
            break
        literals.append(m_line.span(2))
        at = m_line.end()
        if not m.group(1):
            break
    return literals, at


def value_after(text: str, at: int, below: bool = False) -> tuple[list[tuple[int, int]], list[str], list[tuple[int, int]], int]:
    """Quoted literals, referenced names and bare words of the value that starts after an operator, and where it ends."""
    literals, names, bare, n = [], [], [], len(text)
    if below:
        literals, end = lines_below(text, at)
        if literals:
            return literals, names, bare, end
    while True:
        while at < n and text[at] in " \t":
            at += 1
        if at < n and text[at] in "\"'`":
            end, after = closing(text, at)
            if end < 0:
                return literals, names, bare, at + 1
            start = at + (3 if after - end == 3 else 1)
            inner = text[start:end]
            literals.append((start + len(inner) - len(inner.lstrip()), max(start + len(inner) - len(inner.lstrip()), end - len(inner) + len(inner.rstrip()))))
            at = after
        elif m := BRACED.match(text, at):
            names.append(m.group(1))
            at = m.end()
        else:
            m = BARE.match(text, at)
            if not m:
                return literals, names, bare, at
            word = m.group()
            ref = REFERENCE.fullmatch(word.rstrip(".,"))
            if ref:
                names.append(next(g for g in ref.groups() if g))
            if not ref or ref.group(2):
                bare.append((at, at + len(word.rstrip(".,:"))))
            at = m.end()
        after = at
        while after < n and text[after] in " \t":
            after += 1
        if after < n and text[after] == "+":
            at = after + 1
        else:
            return literals, names, bare, at


def assignments(text: str) -> list[tuple[str, list, list[str], list]]:
    """Name, quoted literals, referenced names and bare words of each assignment, in order.

    `name: type = value` assigns to the name, and of an attribute pair (key="name" value="...") the value does."""
    made, pos = [], 0
    typed = (-1, "")  # where the last name with a colon's value starts, and the name
    label = (-1, "")  # where the last key="..." ends, and what it holds
    while m := OPERATOR.search(text, pos):
        name = name_before(text, m.start())
        pos = m.end()
        if m.group() == "=" and name_score(typed[1]) > name_score(name) and ANNOTATION.fullmatch(text, typed[0], m.start()):
            name = typed[1]
            made[-1] = (name, [], [], [])  # what the colon opened is a type
        if not name:
            continue
        literals, names, bare, end = value_after(text, pos, m.group() == ":")
        typed = (pos, name) if m.group() == ":" else (-1, "")
        last = name.rpartition(".")[2].lower()
        if last in VALUE_WORDS and label[0] >= 0 and literals:
            name = label[1] if BETWEEN.fullmatch(text, label[0], m.start()) else name
            label = (-1, "")
        elif last in KEY_WORDS and len(literals) == 1 and not bare:
            label = (literals[0][1] + 1, text[slice(*literals[0])])
        made.append((name, literals, names, bare))
        pos = max(pos, end if literals or names or bare else pos)
        if text[pos - 1 : pos] in ("=", ":") and pos > m.end():
            pos -= 1
    return made


def lexed_spans(text: str) -> list[tuple[int, int, str, float]]:
    """Literals with the name that makes them sensitive and their score."""
    made = assignments(text)
    places: dict[str, list[int]] = {}
    for i, (name, literals, names, bare) in enumerate(made):
        if literals or names or bare:
            places.setdefault(name, []).append(i)

    def definition(name: str, user: int) -> int:
        """The last assignment to a name before its user, otherwise the first one after; -1 without one."""
        known = places.get(name, ())
        at = bisect.bisect_left(known, user)
        if at:
            return known[at - 1]
        return next((i for i in known[at : at + 2] if i != user), -1)

    values, reached = [], []
    for i, (_, literals, names, bare) in enumerate(made):
        to = {name: j for name in dict.fromkeys(names) if (j := definition(name, i)) >= 0}
        reached.append(list(to.values()))
        values.append(literals + [s for s in bare if text[slice(*s)] not in to])
    best: dict[tuple[int, int], tuple[float, str]] = {}
    done = [False] * len(made)
    for source in sorted(((weight, name, i) for i, (name, *_) in enumerate(made) if (weight := name_score(name))), reverse=True):
        todo = [source[2]]  # the weightiest name first, so each assignment is met once, with the weightiest that reaches it
        while todo:
            i = todo.pop()
            if not done[i]:
                done[i] = True
                for s in values[i]:
                    best[s] = max(best.get(s, (0.0, "")), source[:2])
                todo += reached[i]
    scored = ((s, name, weight + literal_score(text[s[0] : s[1]])) for s, (weight, name) in best.items())
    return sorted((a, b, name, round(score, 3)) for (a, b), name, score in scored if score >= LEAST)


def spans_of(text: str | None) -> list[dict]:
    """All spans in order: by start, then kind as listed."""
    if not text:
        return []
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
    out = [{"kind": k, "start": a, "end": b, "name": None, "score": None} for a, b, k in base]
    if "=" in text or ":" in text:
        starts, reach, far = [s[0] for s in base], [], -1
        for s in base:
            far = max(far, s[1])
            reach.append(far)
        for a, b, name, score in lexed_spans(text):
            before = bisect.bisect_right(starts, a)
            if not before or reach[before - 1] < b:
                out.append({"kind": "lexed", "start": a, "end": b, "name": name, "score": score})
        out.sort(key=lambda s: (s["start"], KINDS.index(s["kind"])))
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())])


def scan_batches(batches):
    for batch in slices(batches):
        found = [spans_of(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(SPAN))], names=["doc_id", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, name, score), one row per document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan_batches, "doc_id long, spans array<struct<kind:string,start:int,end:int,name:string,score:double>>")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mark; other columns stay."""
    @F.pandas_udf("string")
    def clean(texts):
        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for s in spans_of(text):
                if s["end"] > at:
                    out += [text[at : max(at, s["start"])], mark if s["start"] >= at else ""]
                    at = s["end"]
            return "".join(out) + text[at:]

        return texts.map(one)

    return docs.withColumn("text", clean("text"))


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "lexed")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), count("lexed").alias("n_lexed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


ORACLE = None  # SQL gives no match positions; tested against plain patterns
