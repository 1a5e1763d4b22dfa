"""Document fingerprints by I-Match over a chosen inverse-document-frequency band and randomised subsets of that lexicon.

A pass over all documents counts each term's documents (terms: runs of anything but ASCII space and punctuation, in
lower case, by 64-bit hash). The lexicon is the terms whose share of documents lies in BAND, so that it has at most
1 / BAND[0] times as many terms as a document has on average, at any scale. Up to LEXICON_TERMS of them go along as a
table (a scalar subquery), more are met by a shuffle. A document's distinct lexicon terms, sorted,
are hashed whole, and again within SUBSETS random subsets that keep a term with odds 1/4, 1/16, 1/64 and 1/256: after an edit
some subset of a fitting size still has the same terms, however long the text. A text without lexicon terms has the
hash of itself. The fingerprint is 65 hashes of 6 hex digits; zeros mark an empty subset.

Likeness is 1 for equal fingerprints, otherwise the best share of equal, non-empty subsets among the four odds.

The order of documents (descending doc_id, ties by text hash, null ids last) is found on narrow rows in ranges of
doc_id; texts are then shuffled once by identifier, and the opening of the next text that an edit needs goes to its
reader by key. Null texts count as empty. Rows that repeat a doc_id and text are one document in this order, and each
gets its result. Documents alone in a table follow themselves. An empty table gives an empty result. Extra columns are
not read. All of it is built-in functions.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, read_table

LEXICON_TERMS, BAND, SUBSETS, ODDS, WIDTH = 200_000, (0.0005, 0.1), 16, (4, 16, 64, 256), 6
TERM_BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
EMPTY, NO_ID = "0" * WIDTH, -(1 << 63)
RANGE_ROWS, QUANTILES, BROADCAST_RANGES = 4096, 1024, 100_000


def term_hashes(text: Column) -> Column:
    hashes = F.transform(F.split(F.lower(text), TERM_BREAK), lambda w: F.xxhash64(w))
    return F.array_remove(F.array_distinct(hashes), F.xxhash64(F.lit("")))


def lexicon(texts: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """The terms whose share of the documents lies in the band: term. texts: text."""
    counted = texts.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    documents = texts.count()
    return keep(counted.filter((F.col("n") >= band[0] * documents) & (F.col("n") <= max(1.0, band[1] * documents))).select("term"), "lexicon")


def table_of(known: DataFrame, lists: int) -> DataFrame:
    """table, one row: the terms in short lists by their hash modulo the number of lists, for at most LEXICON_TERMS of them."""
    spot = F.pmod("term", F.lit(lists))
    held = known.groupBy(spot.alias("at")).agg(F.collect_list("term").alias("terms"))
    every = known.sparkSession.range(lists).withColumnRenamed("id", "at").join(held, "at", "left")
    in_order = F.array_sort(F.collect_list(F.struct("at", F.coalesce("terms", F.array().cast("array<long>")).alias("terms"))))
    return keep(every.agg(F.transform(in_order, lambda x: x["terms"]).alias("table")), "table")


def in_lexicon(rows: DataFrame, text: str, known: DataFrame, table: DataFrame | None, lists: int) -> DataFrame:
    """rows (k, th, which stand for the text, and others) with terms: the text's terms that are known, sorted."""
    if table is None:
        met = rows.select("k", "th", F.explode(term_hashes(F.col(text))).alias("term")).join(known, "term", "left_semi").groupBy("k", "th").agg(F.sort_array(F.collect_set("term")).alias("terms"))
        return rows.join(met, ["k", "th"], "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<long>")))
    # The table is a scalar subquery: it is worked out once and is no part of the plan's text. The projection that uses it
    # is merged with this one, so rows do not carry it.
    looked_up = lambda t: F.sort_array(F.filter(term_hashes(F.col(text)), lambda h: F.array_contains(F.get(t, F.pmod(h, F.lit(lists)).cast("int")), h)))
    return rows.withColumn("_table", table.scalar()).withColumn("terms", bound(F.col("_table"), looked_up)).drop("_table")


def short_hash(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.substring(F.lower(F.hex(F.xxhash64(values))), -WIDTH, WIDTH)).otherwise(EMPTY)


def bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fingerprint(text: Column, terms: Column) -> Column:
    def subset(terms: Column, i: Column, level: int = 0) -> Column:
        """Hashes of nested subsets: each level thins the one before."""
        kept = F.filter(terms, lambda t: F.pmod(F.xxhash64(i, t), F.lit(ODDS[level])) == 0)
        if level + 1 == len(ODDS):
            return short_hash(kept)
        return bound(kept, lambda fewer: F.concat(short_hash(fewer), subset(fewer, i, level + 1)))

    whole = lambda t: F.when(F.size(t) > 0, short_hash(t)).otherwise(F.substring(F.lower(F.hex(F.xxhash64(F.lit("text"), text))), -WIDTH, WIDTH))
    return bound(terms, lambda t: F.concat(whole(t), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda i: subset(t, i)), "")))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints as bytes. Both should be columns, not expressions, as their parts are cut out many times."""
    size = WIDTH // 2
    part = lambda x, k: F.substring(x, k * size + 1, size)
    same = lambda k: ((part(a, k) == part(b, k)) & (part(a, k) != F.lit(bytes(size)))).cast("int")
    levels = [functools.reduce(operator.add, (same(1 + i * len(ODDS) + level) for i in range(SUBSETS))) for level in range(len(ODDS))]
    return F.when(a == b, 1.0).otherwise(F.greatest(*levels) / F.lit(float(SUBSETS)))


def told(fp: Column) -> Column:
    return F.lower(F.hex(fp))


def chain(nodes: DataFrame) -> DataFrame:
    """nodes: k, th, n_chars, fp (as bytes), one row each. Adds near_next, and for the row before it prev_k, prev_th, need."""
    n = nodes.count()
    parts = max(1, min(QUANTILES, n // RANGE_ROWS))
    pieces = -(-n // (parts * RANGE_ROWS)) or 1  # of each part, so that ranges grow in number and not in size
    cuts = [i / parts for i in range(1, parts)]
    told_ = nodes.agg(F.max("k").alias("top"), F.min("k").alias("least"), (F.percentile_approx("k", cuts, 10_000) if cuts else F.lit(None)).alias("cuts")).first()
    edges = sorted(set(told_["cuts"] or ()), reverse=True)
    top, least = told_["top"] or 0, told_["least"] or 0
    order = [F.col("k").desc(), F.col("th").asc()]
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values]).cast("array<long>")
    part = F.size(F.filter(longs(edges), lambda b: b >= F.col("k")))  # 0 has the largest ids
    high, low = F.get(longs([top, *edges]), part).cast("double"), F.get(longs([*edges, least]), part).cast("double")
    piece = F.floor((high - F.col("k").cast("double")) / F.greatest(high - low, F.lit(1.0)) * pieces)
    ranged = nodes.withColumn("range", part.cast("long") * pieces + F.least(piece, F.lit(pieces - 1)))
    row = F.struct(F.col("k"), (-F.col("th")).alias("order"), "th", "n_chars", "fp")
    ends = ranged.groupBy("range").agg(F.max(row).alias("first"), F.min(row).alias("last"))
    by_range = Window.orderBy("range")
    all_ranges = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("range", F.coalesce(F.lead("first").over(by_range), F.first("first").over(all_ranges)).alias("after"), F.coalesce(F.lag("last").over(by_range), F.last("last").over(all_ranges)).alias("before"))
    inside = Window.partitionBy("range").orderBy(*order)
    prev = F.lag(F.struct("k", "th", "n_chars")).over(inside)
    return (
        ranged.withColumn("prev", prev).withColumn("next_fp", F.lead("fp").over(inside))
        .join(F.broadcast(ends) if parts * pieces <= BROADCAST_RANGES else ends, "range")
        .withColumn("prev", F.coalesce("prev", F.struct("before.k", "before.th", "before.n_chars")))
        .withColumn("next_fp", F.coalesce("next_fp", F.col("after.fp")))
        .select("k", "th", "n_chars", "fp", likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), F.col("prev.k").alias("prev_k"), F.col("prev.th").alias("prev_th"), F.floor(F.col("prev.n_chars") / 3).cast("int").alias("need"))
    )


def report(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k"), text.alias("text"), F.xxhash64(text).alias("th"))
    known = lexicon(base.select("text"), band)
    lists = max(1, known.count())
    table = table_of(known, lists) if lists <= LEXICON_TERMS else None
    rows = keep(in_lexicon(base, "text", known, table, lists).select("k", "th", F.char_length("text").cast("long").alias("n_chars"), F.unhex(fingerprint(F.col("text"), F.col("terms"))).alias("fp")), "fingerprints")
    linked = keep(chain(rows.dropDuplicates(["k", "th"])), "chain")
    openings = (
        base.join(linked.select("k", "th", "prev_k", "prev_th", "need"), ["k", "th"])
        .select(F.col("prev_k").alias("k"), F.col("prev_th").alias("th"), F.struct(F.expr("left(text, need)").alias("text"), "doc_id").alias("opening"))  # with doc_id, both reads of base share one shuffle
        .groupBy("k", "th").agg(F.first("opening").alias("opening"))
        .select("k", "th", F.col("opening.text").alias("opening"), F.col("opening.doc_id").alias("next_id"))
    )
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 3) as int))"), F.expr("left(opening, cast(floor(n_chars / 3) as int))"))
    pairs = (
        base.join(linked.select("k", "th", "n_chars", "fp", "near_next"), ["k", "th"]).join(openings, ["k", "th"])
        .select("k", "th", "doc_id", "n_chars", "fp", "near_next", "next_id", edited.alias("edited"))
    )
    return (
        in_lexicon(pairs, "edited", known, table, lists)
        .select("doc_id", "n_chars", "fp", "near_next", "next_id", F.sha2("edited", 256).alias("edited_sha256"), F.unhex(fingerprint(F.col("edited"), F.col("terms"))).alias("edited_fp"))
        .select("doc_id", "n_chars", "edited_sha256", told(F.col("fp")).alias("fingerprint"), told(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), "near_next", "next_id")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(read_table(spark, sf_dir, "documents"))


ORACLE = None  # terms are hashed; tested against brute force
