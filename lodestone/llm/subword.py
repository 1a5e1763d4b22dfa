"""SentencePiece encoding by sampling distinct segmentations without replacement, and decoding.

The lattice of a text has an edge for every vocabulary piece that matches at a place; pieces do not cross the start of a
word (a space opens each word, as the tokenizer's own pre-split has it), a character without a piece is one edge of its
UTF-8 byte pieces, and so is a literal U+2581, so that decoding gives the text back exactly. Pieces carry
log-probabilities: a unigram model's own, or, from a merge list, by Zipf's law over the rank of the merge.

Sampling is Gumbel top-k by A-star search: forward sums over the lattice give every step's exact conditional
probabilities, so a node of the search tree (a partial segmentation) has the log-mass of all its completions, and its
perturbed value is the maximum of theirs. The search keeps an agenda of sets "the path so far, then another edge than
those taken", each with a Gumbel of its mass truncated at its parent's value; popping the largest gives the next distinct
segmentation in falling perturbed order, without rejection. With the (k+1)-th value as threshold, the inclusion
probability of a segmentation is 1 - exp(-exp(log p - threshold)). Random numbers are hashes of (seed, row key, sample,
place), so a row's samples do not depend on its partition.

A word of many characters is cut where no piece spans two neighbours; the parts are independent, so texts without spaces
(lines, tables, scripts that have none) cost what others do. Words are looked up once per block of documents, and sums, draws and agenda values are array operations over the block.
Null texts count as empty and have one empty segmentation; a text with fewer than k segmentations gives them all. Whole
texts are encoded. Repeated rows give repeated results; an empty table an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, small_batches

MODEL, SAMPLES, SEED, ZIPF = "/opt/tokenizers/piece_bpe_32k.model", 2, 7, 10.0
SPACE, BLOCK_WORDS = "▁", 100_000
#: Words of more characters are cut where no piece spans, so many characters at a time; a block counts a word for so many.
LONG_WORD, CUT_CHARS, WORD_CHARS = 32, 1 << 18, 8
#: Steps looked at first (then so many times more), and the largest Gumbel that `uniform` can give, rounded up.
WINDOW, WIDER, NOISE = 512, 2, 37.0
#: Most pieces that end at a place have at most so many characters; sums over longer ones are made only where there are some.
NARROW = 4
#: Sums over up to so many words are made for all lengths at once, as a long word has many places.
FEW = 48
U = np.uint64


class Vocabulary:
    """Pieces as arrays: what they decode to, their log-probabilities, and a trie over character classes."""

    def __init__(self, pieces: list[str], log_probs: np.ndarray, byte_ids: np.ndarray):
        self.pieces, self.log_probs, self.byte_ids = pieces, log_probs, byte_ids
        self.bytes = [p.replace(SPACE, " ").encode() for p in pieces]
        for value, i in enumerate(byte_ids.tolist()):
            if i >= 0:
                self.bytes[i] = bytes([value])

    @classmethod
    def load(cls, model: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.vocab_size()
        pieces, scores = [sp.id_to_piece(i) for i in range(n)], np.array([sp.get_score(i) for i in range(n)])
        byte_ids = np.full(256, -1)
        usable = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)])
        for i in range(n):
            if sp.is_byte(i):
                byte_ids[int(pieces[i][3:5], 16)] = i
        if (scores == np.round(scores)).all():  # ranks of merges
            order = np.argsort(np.argsort(-np.where(usable, scores, -np.inf), kind="stable"), kind="stable")
            weight = np.where(usable, 1.0 / (order + ZIPF), 0.0)
        else:
            weight = np.where(usable, np.exp(scores), 0.0)
        weight[byte_ids[byte_ids >= 0]] = weight[usable].min() / 2
        with np.errstate(divide="ignore"):
            return cls(pieces, np.log(weight / weight.sum()), byte_ids)

    def plain(self) -> tuple:
        return self.pieces, self.log_probs, self.byte_ids


class Trie:
    """Children by (node, character class): a dense table for the commonest classes, a sorted list for the others."""

    DENSE = 128
    PARTS = ("classes", "width", "kinds", "piece", "dense", "keys", "to")

    def __init__(self, parts: tuple):
        for name, value in zip(self.PARTS, parts, strict=True):
            setattr(self, name, value)

    def plain(self) -> tuple:
        return tuple(getattr(self, name) for name in self.PARTS)

    @classmethod
    def build(cls, vocabulary: Vocabulary) -> Trie:
        self = cls.__new__(cls)
        entries = [(p, i) for i, p in enumerate(vocabulary.pieces) if np.isfinite(vocabulary.log_probs[i]) and vocabulary.bytes[i].decode("utf-8", "replace") == p.replace(SPACE, " ") and SPACE not in p[1:]]
        counts: dict[str, int] = {}
        for p, _ in entries:
            for c in p:
                counts[c] = counts.get(c, 0) + 1
        letters = sorted(counts, key=lambda c: (-counts[c], c))
        self.classes = np.zeros(0x110000, np.int16)
        for k, c in enumerate(letters):
            self.classes[ord(" " if c == SPACE else c)] = k + 1
        self.classes[ord(SPACE)] = 0
        self.width = max(len(p) for p, _ in entries)
        self.kinds = len(letters) + 1
        child: dict[tuple[int, int], int] = {}
        piece = [-1]
        rank = {c: k + 1 for k, c in enumerate(letters)}
        for p, i in entries:
            node = 0
            for c in p:
                at = (node, rank[c])
                if at not in child:
                    child[at] = len(piece)
                    piece.append(-1)
                node = child[at]
            piece[node] = i
        self.piece = np.array(piece, np.int32)
        self.dense = np.zeros((len(piece), self.DENSE), np.int32)
        rare = sorted((node * self.kinds + c, to) for (node, c), to in child.items() if c >= self.DENSE)
        for (node, c), to in child.items():
            if c < self.DENSE:
                self.dense[node, c] = to
        self.keys = np.array([k for k, _ in rare] + [np.iinfo(np.int64).max], np.int64)
        self.to = np.array([t for _, t in rare] + [0], np.int32)
        return self

    def step(self, nodes: np.ndarray, classes: np.ndarray) -> np.ndarray:
        out = self.dense.ravel().take(nodes * np.int64(self.DENSE) + np.minimum(classes, self.DENSE - 1))
        rare = np.flatnonzero(classes >= self.DENSE)
        if len(rare):
            wanted = nodes[rare].astype(np.int64) * self.kinds + classes[rare]
            at = np.searchsorted(self.keys, wanted)
            out[rare] = np.where(self.keys[at] == wanted, self.to[at], 0)
        out[classes == 0] = 0
        return out


def cut(words: list[str], trie: Trie) -> list[list[str]]:
    """Long words (each opened by a space) in parts that no piece spans, so that their segmentations are independent.

    A text without spaces (lines, tables, scripts that have none) is one word here; its parts are as short as words."""
    text = "".join(words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    far = np.empty(len(codes), np.int64)  # how far the pieces that start at a character reach
    for start in range(0, len(codes), CUT_CHARS):
        classes = trie.classes[codes[start : start + CUT_CHARS + trie.width]].astype(np.int32)
        n = min(CUT_CHARS, len(codes) - start)
        far[start : start + n] = np.arange(start + 1, start + n + 1)
        at, nodes = np.arange(n), np.zeros(n, np.int32)
        for length in range(1, trie.width + 1):
            on = at + length <= len(classes)
            at, nodes = at[on], trie.step(nodes[on], classes.take(at[on] + (length - 1)))
            on = np.flatnonzero(nodes)
            at, nodes = at.take(on), nodes.take(on)
            hit = at[trie.piece.take(nodes) >= 0]
            far[start + hit] = start + hit + length
    edges = np.arange(1, len(codes))
    ends = np.append(edges[np.maximum.accumulate(far)[:-1] <= edges], len(codes)).tolist()  # pieces cross no start of a word, so words end there too
    out: list[list[str]] = []
    begin = 0
    for end in ends:
        if text[begin] == " ":
            out.append([])
        out[-1].append(text[begin:end])
        begin = end
    return out


class Lattice:
    """All words of a block: a row per character of each different word, and the edges that end there, by length.

    Words start with the space that opens them; parts of long words that no piece spans are words of their own. Rows go by
    the character's place in its word, then by rank of the word, longest first: the words that reach a place are the first
    ones there, so that sums, place by place, are over contiguous columns of all words at once.

    piece[n-1, row]: the piece of n characters that ends at row, -1 without one, -2-c for the bytes of character c.
    log_q: its log-probability given that an edge ends there, from forward sums over all segmentations of the word up
    to there. cum: the same, cumulative over n."""

    def __init__(self, words: list[str], trie: Trie, vocabulary: Vocabulary):
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-self.size, kind="stable")
        self.rank = np.empty(len(words), np.int64)
        self.rank[order] = np.arange(len(words))
        text = "".join(map(words.__getitem__, order.tolist()))
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes, n = self.size[order], len(codes)
        reach = len(words) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(words) else 0), side="right")  # words with a character at a place
        self.first = np.concatenate([[0], np.cumsum(reach)])
        ends = np.repeat(np.cumsum(sizes), sizes)
        room = ends - np.arange(n)  # characters from here to the word's end
        row = self.first.take(np.repeat(sizes, sizes) - room) + np.repeat(np.arange(len(words)), sizes)
        classes = trie.classes[codes].astype(np.int32)
        hits = []
        at, nodes = np.arange(n), np.zeros(n, np.int32)
        for length in range(1, trie.width + 1):
            if length > 1:
                on = np.flatnonzero(room.take(at) >= length)
                at, nodes = at.take(on), nodes.take(on)
            nodes = trie.step(nodes, classes.take(at + (length - 1)))
            on = np.flatnonzero(nodes)
            at, nodes = at.take(on), nodes.take(on)
            found = trie.piece.take(nodes)
            hit = np.flatnonzero(found >= 0)
            hits.append((row.take(at.take(hit) + (length - 1)), found.take(hit)))
        self.width = width = max((length for length, (rows, _) in enumerate(hits, 1) if rows.size), default=1)
        self.piece, self.log_q = np.full((width, n), -1, np.int32), np.full((width, n), -np.inf)
        far = np.zeros(n, bool)
        for length, (rows, found) in enumerate(hits[:width], 1):
            self.piece[length - 1][rows] = found
            self.log_q[length - 1][rows] = vocabulary.log_probs.take(found)
            if length > NARROW:
                far[rows] = True
        bare = np.flatnonzero(self.piece[0].take(row) < 0)
        letters, which = np.unique(codes[bare], return_inverse=True)
        lengths = np.array([len(chr(c).encode("utf-8", "surrogatepass")) for c in letters.tolist()], np.float64)
        self.piece[0][row[bare]] = -2 - codes[bare].astype(np.int32)
        if len(bare):
            self.log_q[0][row[bare]] = lengths[which] * float(vocabulary.log_probs[vocabulary.byte_ids].min())
        self.cum, alpha, ranks = np.ones((width, n), np.float32), np.zeros(n), np.arange(FEW)

        def sums(edge: np.ndarray, place: int, some: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            """Forward sums at a place, of all words there or of some, over the edges given; these become log-odds, what comes back their sums and cumulative odds."""
            inner, many = min(len(edge), place), edge.shape[1] > FEW  # edges that do not open the word
            if many and some is None:
                for length in range(1, inner + 1):
                    begin = int(self.first[place - length])
                    edge[length - 1] += alpha[begin : begin + edge.shape[1]]
            else:
                edge[:inner] += alpha.take(self.first[place - inner : place][::-1, None] + (ranks[: edge.shape[1]] if some is None else some))
            top = edge.max(axis=0)
            odds = np.exp(edge - top)
            if many:
                for length in range(1, len(odds)):
                    odds[length] += odds[length - 1]
            else:
                np.cumsum(odds, axis=0, out=odds)
            total = top + np.log(odds[-1])
            edge -= total
            odds /= odds[-1].copy()
            return total, odds

        for place, count in enumerate(reach.tolist()):
            rows = slice(int(self.first[place]), int(self.first[place]) + count)
            whole = min(place + 1, width)
            span = min(whole, NARROW) if count > FEW else whole
            some = np.flatnonzero(far[rows]) if whole > span else []  # few ends have a long edge
            edge = self.log_q[:whole, rows].take(some, axis=1) if len(some) else None
            alpha[rows], self.cum[:span, rows] = sums(self.log_q[:span, rows], place, None)
            if edge is not None:
                alpha[rows.start + some], odds = sums(edge, place, some)
                self.log_q[:whole, rows.start + some], self.cum[:whole, rows.start + some] = edge, odds
        np.minimum(self.log_q, 0.0, out=self.log_q)

    def at(self, edges: np.ndarray, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of piece or log_q: the values of the edges of these lengths that end at rows."""
        return edges.ravel().take((lengths - 1) * edges.shape[1] + rows)

    def draw(self, rows: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Lengths of the edges that end at rows, by the cumulative odds that u falls in."""
        length, at = np.ones(len(rows), np.int64), np.arange(len(rows))
        for cum in self.cum:
            on = np.flatnonzero(cum.take(rows) < u)
            if not on.size:
                break
            rows, u, at = rows.take(on), u.take(on), at.take(on)
            length[at] += 1
        return length


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Between 0 and 1, neither included, by key."""
    return ((scramble(keys + U(salt * 0x9E3779B97F4A7C15 % (1 << 64))) >> U(12)).astype(np.float64) + 0.5) / float(1 << 52)


class Path:
    """Segmentations of a block's documents, a row per step: word, lattice row, edge length, log-odds; steps of a word go from its end."""

    def __init__(self, word, row, length, log_p, ends):
        self.word, self.row, self.length, self.log_p, self.ends = word, row, length, log_p, ends

    def doc(self, i: int) -> slice:
        return slice(self.ends[i - 1] if i else 0, self.ends[i])


def walk(lattice: Lattice, kind: np.ndarray, word: np.ndarray, left: np.ndarray, keys: np.ndarray, sample: int) -> tuple:
    """Draw the steps of each word with `left` characters to go; returns word, row, length, log_p by word and step."""
    got, at, rank = [], np.flatnonzero(left > 0), lattice.rank.take(kind)
    left = left.copy()
    step = 0
    while len(at):
        now = left.take(at)
        row = lattice.first.take(now - 1) + rank.take(at)
        u = uniform(keys.take(at) + U(step * 0x632BE59BD9B4E019 % (1 << 64)), 2 * sample + 1).astype(np.float32)
        length = lattice.draw(row, u)
        got.append((at, row, length, lattice.at(lattice.log_q, row, length)))
        now -= length
        left[at] = now
        at = at[now > 0]
        step += 1
    steps = np.zeros(len(word), np.int64)
    for a, *_ in got:
        steps[a] += 1
    first = np.concatenate([[0], np.cumsum(steps)])[:-1]
    n = int(steps.sum())
    out = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n)
    for k, (a, row, length, log_p) in enumerate(got):
        spot = first[a] + k
        for column, values in zip(out, (word[a], row, length, log_p), strict=True):
            column[spot] = values
    return out


def best_of(values: np.ndarray, ends: np.ndarray, k: int) -> list[list[int]]:
    """Places of the k largest finite values of each segment, largest first."""
    values = values.copy()
    starts = np.concatenate([[0], ends[:-1]])
    full = np.flatnonzero(ends > starts)
    owner = np.repeat(np.arange(len(ends)), ends - starts)
    out: list[list[int]] = [[] for _ in ends]
    for _ in range(k):
        if not len(full):
            break
        top = np.full(len(ends), -np.inf)
        top[full] = np.maximum.reduceat(values, starts[full])
        hit = np.flatnonzero((values == top[owner]) & np.isfinite(values))
        docs, first = np.unique(owner[hit], return_index=True)
        for d, p in zip(docs.tolist(), hit[first].tolist(), strict=True):
            out[d].append(p)
        values[hit[first]] = -np.inf
    return out


def agenda_values(path: Path, slots: np.ndarray, level: np.ndarray, keys: np.ndarray, after: np.ndarray, sample: int, window: int):
    """Perturbed values of "another edge here", truncated at the document's, for each step from `after` on, `window` at most.

    Returns values, the log-mass before each, their places in the path, the ends by slot, and the log-mass after the last."""
    starts = np.concatenate([[0], path.ends[:-1]])[slots]
    lows = starts + after[slots]
    highs = np.minimum(path.ends[slots], lows + window)
    highs = np.maximum(highs, lows)
    counts = highs - lows
    ends = np.cumsum(counts)
    before, rest = np.empty(int(counts.sum())), np.zeros(len(slots))
    for i, (s, a, b, e) in enumerate(zip(starts.tolist(), lows.tolist(), highs.tolist(), ends.tolist(), strict=True)):  # each alone, so that the block does not change the rounding
        sums = np.cumsum(path.log_p[s:b])
        before[e - (b - a) : e] = sums[a - s :]
        if b > s:
            rest[i] = sums[-1]
    owner = np.repeat(np.arange(len(slots)), counts)
    spot = np.arange(len(before)) - (ends - counts)[owner] + lows[owner]
    log_p = path.log_p.take(spot)
    before -= log_p
    mass = before + np.log(-np.expm1(log_p))
    e = -np.log(uniform(keys[slots][owner] + (spot - starts[owner]).astype(U) * U(0xD1342543DE82EF95), 2 * sample + 2))
    return -np.log(np.exp(-level[slots][owner]) + e * np.exp(-mass)), before, spot, ends, rest


def in_parts(words: list[str], kind: np.ndarray, count: np.ndarray, trie: Trie) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, which of them each word of the block is, words by document; the same with long words cut in parts."""
    opened = [" " + w for w in words]
    long = np.flatnonzero(np.fromiter(map(len, words), np.int64, len(words)) > LONG_WORD).tolist()
    if not long:
        return opened, kind, count
    sizes, more, known = np.ones(len(words), np.int64), [], {}
    for i, (first, *others) in zip(long, cut([opened[i] for i in long], trie), strict=True):
        opened[i] = first  # the word stands for its first part
        sizes[i] += len(others)
        more += [known.setdefault(part, len(words) + len(known)) for part in others]
    flat = np.repeat(np.arange(len(words)), sizes)
    flat[np.flatnonzero(flat[1:] == flat[:-1]) + 1] = more
    times = sizes[kind]
    ends = np.cumsum(times)
    spread = np.arange(int(ends[-1])) - np.repeat(ends - times - (np.cumsum(sizes) - sizes)[kind], times)
    return opened + list(known), flat[spread], np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])])


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words in order of appearance, which of them each word of the block is, words by document (none in an empty one)."""
    split = pc.split_pattern(pa.array([t.encode("utf-8", "surrogatepass") or None for t in texts], pa.large_binary()), b" ")
    every = split.flatten().dictionary_encode()
    different = [w.decode("utf-8", "surrogatepass") for w in every.dictionary.to_numpy(zero_copy_only=False)]
    return different, every.indices.to_numpy().astype(np.int64), pc.fill_null(pc.list_value_length(split), 0).to_numpy().astype(np.int64)


def sample_block(texts: list[str], row_keys: np.ndarray, trie: Trie, vocabulary: Vocabulary, k: int):
    """Per sample: documents that have it, ids (flat), their ends, log-probabilities, perturbed values, log inclusion."""
    different, kind, count = in_parts(*words_of(texts), trie)
    word_ends = np.cumsum(count)
    word_starts = word_ends - count
    owner = np.repeat(np.arange(len(texts)), count)
    lattice = Lattice(different, trie, vocabulary)
    place = np.arange(len(kind)) - word_starts[owner]
    keys = scramble(row_keys[owner] + place.astype(U) * U(0xA24BAED4963EE407))
    size = lattice.size[kind]
    columns = walk(lattice, kind, np.arange(len(kind)), size, keys, 0)
    ends = np.searchsorted(columns[0], word_ends, side="left")
    paths = [Path(*columns, ends)]
    levels = [-np.log(-np.log(uniform(row_keys, 0)))]
    agenda: list[list[tuple]] = [[] for _ in texts]  # (value, sample, step in the document, log-mass before, edges taken)

    def note(path: Path, docs: np.ndarray, level: np.ndarray, after: np.ndarray, sample: int) -> None:
        """The k largest values of each document go to its agenda. A value exceeds its log-mass by NOISE at most, and masses
        fall along the text, so the first steps decide unless the mass after them could still reach the k-th value."""
        slots, window = np.arange(len(docs)), WINDOW
        while len(slots):
            value, before, spot, ends, rest = agenda_values(path, slots, level, row_keys[docs], after, sample, window)
            again = []
            for slot, tops, e, left in zip(slots.tolist(), best_of(value, ends, k), path.ends[slots].tolist(), rest.tolist(), strict=True):
                begin = int(path.ends[slot - 1]) if slot else 0
                if e - begin - int(after[slot]) > window and (len(tops) < k or value[tops[-1]] <= left + NOISE):
                    again.append(slot)
                else:
                    agenda[docs[slot]] += [(float(value[p]), sample, slot, int(spot[p]) - begin, float(before[p]), (int(path.length[spot[p]]),)) for p in tops]
            slots, window = np.array(again, np.int64), window * WIDER

    everyone = np.arange(len(texts))
    note(paths[0], everyone, levels[0], np.zeros(len(texts), np.int64), 0)
    members = [everyone]
    for sample in range(1, k):
        docs, parts, fresh, level, after = [], [], [], [], []
        for d in members[-1].tolist():
            if not agenda[d]:
                continue
            best = max(range(len(agenda[d])), key=lambda i: agenda[d][i][0])
            value, parent, slot, step, before, taken = agenda[d].pop(best)
            path = paths[parent]
            begin = path.ends[slot - 1] if slot else 0
            spot = begin + step
            row, word = path.row[spot], int(path.word[spot])
            left = int(np.searchsorted(lattice.first, row, side="right"))
            lengths = np.flatnonzero(lattice.piece[:left, row] != -1) + 1
            log_p = lattice.log_q[lengths - 1, row]
            open_ = np.array([n not in taken for n in lengths.tolist()])
            lengths, log_p = lengths[open_], log_p[open_]
            u = float(uniform(row_keys[d : d + 1] + U((sample * 1_000_003 + step) % (1 << 63)), 3)[0])
            odds = np.cumsum(np.exp(log_p - log_p.max()))
            pick = min(int(np.searchsorted(odds, u * odds[-1], side="left")), len(odds) - 1)
            rest = np.delete(log_p, pick)
            if len(rest):
                mass = before + rest.max() + np.log(np.exp(rest - rest.max()).sum())
                e = -np.log(float(uniform(row_keys[d : d + 1] + U((sample * 1_000_003 + step) % (1 << 63)), 4)[0]))
                again = -np.log(np.exp(-value) + e * np.exp(-mass))
                if np.isfinite(again):
                    agenda[d].append((again, parent, slot, step, before, (*taken, int(lengths[pick]))))
            docs.append(d)
            level.append(value)
            after.append(step + 1)
            parts.append((path, begin, spot, word, int(row), int(lengths[pick]), float(log_p[pick])))
            fresh.append((word, left - int(lengths[pick]), int(word_ends[d])))
        if not docs:
            break
        todo = np.array([0 if w >= e else e - w for w, _, e in fresh])
        words = np.concatenate([np.arange(w, e) for w, _, e in fresh])
        left = size[words]
        left[np.cumsum(todo) - todo] = [n for _, n, _ in fresh]
        drawn = walk(lattice, kind[words], words, left, keys[words], sample)
        cuts = np.searchsorted(drawn[0], [w for w, _, _ in fresh]), np.searchsorted(drawn[0], [e for _, _, e in fresh])
        pieces: list[list[np.ndarray]] = [[], [], [], []]
        lengths_of = []
        for i, (path, begin, spot, word, row, length, log_p) in enumerate(parts):
            old = slice(begin, spot)
            new = slice(int(cuts[0][i]), int(cuts[1][i]))
            for column, source, one, more in zip(pieces, (path.word, path.row, path.length, path.log_p), (word, row, length, log_p), drawn, strict=True):
                column += [source[old], [one], more[new]]
            lengths_of.append(spot - begin + 1 + new.stop - new.start)
        path = Path(*(np.concatenate(c) for c in pieces), np.cumsum(lengths_of))
        docs_at, value = np.array(docs), np.array(level)
        paths.append(path)
        members.append(docs_at)
        levels.append(value)
        note(path, docs_at, value, np.array(after), sample)
    threshold = np.array([max((a[0] for a in items), default=-np.inf) for items in agenda])
    for path, docs, level in zip(paths, members, levels, strict=True):
        starts = np.concatenate([[0], path.ends[:-1]])
        log_p = np.zeros(len(docs))
        full = path.ends > starts
        if full.any():
            log_p[full] = np.add.reduceat(path.log_p, starts[full])
        gap = log_p - threshold[docs]
        inclusion = np.where(gap < -30, gap, np.log(-np.expm1(-np.exp(np.minimum(gap, 30)))))
        ids, counts = ids_of(path, lattice, vocabulary)
        ends_of_ids = np.concatenate([[0], np.cumsum(counts)])[path.ends] if len(counts) else np.zeros(len(docs), np.int64)
        yield docs, ids, ends_of_ids, log_p, level, inclusion


def ids_of(path: Path, lattice: Lattice, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids in reading order, and how many each step (in path order within its word's turn) gives."""
    n = len(path.word)
    new = np.ones(n, bool)
    new[1:] = (path.word[1:] != path.word[:-1]) | (path.row[1:] > path.row[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, n))
    back = np.repeat(2 * begin + size - 1, size) - np.arange(n)
    pieces = lattice.at(lattice.piece, path.row.take(back), path.length.take(back))
    odd = np.flatnonzero(pieces < 0)
    counts = np.ones(n, np.int64)
    if not len(odd):
        return pieces, counts
    letters, which = np.unique(pieces[odd], return_inverse=True)
    spelt = [vocabulary.byte_ids[list(chr(-2 - c).encode("utf-8", "surrogatepass"))] for c in letters.tolist()]
    widths = np.array([len(x) for x in spelt])[which]
    counts[odd] = widths
    begins = np.cumsum(counts)[odd] - widths
    out = np.repeat(pieces, counts)
    for k in range(int(widths.max())):
        some = np.flatnonzero(widths > k)
        out[begins[some] + k] = np.array([x[k] if k < len(x) else -1 for x in spelt])[which[some]]
    return out, counts


def row_key(doc_id, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id), seed)


def decode_ids(ids: list[int], table: list[bytes]) -> str:
    """The text again: the pieces' bytes, without the space that opens the first word."""
    return b"".join(map(table.__getitem__, ids))[1:].decode("utf-8", "surrogatepass")


def decodes(ids: np.ndarray, starts, ends, docs, spelt: list[bytes], table: pa.Array) -> list[bool]:
    """Whether each document's ids decode to its text, by bytes: all ids of a sample are decoded in one run."""
    _, offsets, whole = table.take(pa.array(ids)).buffers()
    at, whole = np.frombuffer(offsets, np.int64), whole.to_pybytes() if whole else b""
    return [whole[a + (b > a) : b] == spelt[d] for a, b, d in zip(at[starts].tolist(), at[ends].tolist(), docs.tolist(), strict=True)]


def encode_batches(batches, plain: tuple, k: int, seed: int, check: bool):
    """plain: the vocabulary's and the trie's parts."""
    vocabulary, trie = Vocabulary(*plain[0]), Trie(plain[1])
    table = pa.array(vocabulary.bytes, pa.large_binary())
    schema = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("perturbed", pa.float64()), ("log_inclusion", pa.float64()), ("exact", pa.bool_())])
    for batch in slices(batches):
        doc_ids = batch.column("doc_id").to_pylist()
        texts = [t or "" for t in batch.column("text").to_pylist()]
        spaces = [max(t.count(" "), len(t) // WORD_CHARS) for t in texts]
        start = 0
        while start < len(texts):
            stop, words = start + 1, spaces[start]
            while stop < len(texts) and words + spaces[stop] < BLOCK_WORDS:
                words += spaces[stop] + 1
                stop += 1
            part = texts[start:stop]
            keys = np.array([row_key(d, seed) for d in doc_ids[start:stop]], U)
            spelt = [t.encode("utf-8", "surrogatepass") for t in part] if check else []
            with np.errstate(all="ignore"):
                for sample, (docs, ids, ends, log_p, level, inclusion) in enumerate(sample_block(part, keys, trie, vocabulary, k)):
                    starts = np.concatenate([[0], ends[:-1]])
                    exact = decodes(ids, starts, ends, docs, spelt, table) if check else [None] * len(docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc_ids[start + d] for d in docs.tolist()], pa.int64()), pa.array(np.full(len(docs), sample, np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(log_p), pa.array(level), pa.array(inclusion), pa.array(exact, pa.bool_())],
                        schema=schema,
                    )
            start = stop


def model_path(spark: SparkSession, model: str | None) -> str:
    """The vocabulary file: as given, else by the setting lodestone.tokenizer, else MODEL. The driver alone reads it."""
    return model or spark.conf.get("lodestone.tokenizer", MODEL)


def encode(docs: DataFrame, k: int = SAMPLES, model: str | None = None, seed: int = SEED, check: bool = False) -> DataFrame:
    """doc_id, sample (from 0, by falling perturbed value), ids, log_prob, perturbed, log_inclusion; with check, exact: it decodes to the text."""
    small_batches(docs.sparkSession)
    vocabulary = Vocabulary.load(model_path(docs.sparkSession, model))
    held = docs.sparkSession.sparkContext.broadcast((vocabulary.plain(), Trie.build(vocabulary).plain()))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: encode_batches(batches, held.value, k, seed, check), "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double, exact boolean")


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded (any columns, ids) with text, what the ids decode to."""
    held = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model_path(encoded.sparkSession, model)).bytes)

    @F.pandas_udf("string")
    def text(ids):
        table = held.value
        return ids.map(lambda x: None if x is None else decode_ids(list(x), table))

    return encoded.withColumn("text", text("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read_table(spark, sf_dir, "documents"), check=True)


ORACLE = None  # sampled segmentations; tested by enumeration and exact round trips
