"""Collocations by hierarchical pair naming: frequent phrases of k words are pairs of frequent phrases of k - 1 words.

Words are counted first, by language. A phrase of k words is the pair of the phrases of its
first and of its last k - 1 words; only places where both are frequent are counted, and the
frequent pairs are joined with the level below, which gives each a new id and the ids of both
halves. These parent pointers serve twice: along them a phrase collects the counts of all its
first and last parts, for the cuts, and against them the level above tells which phrases it
contains. Levels are counted from the texts by sums that are combined on the map side; no text
is shuffled.

A word's name in a task is a 64-bit hash of its language and its bytes. A frequent word that
shared its name with any other word would give another seed; so a key of k names is the phrase,
and counts are exact. Tasks get a bitmap of the names that are frequent, of a fixed size: a
place that it lets through by mistake is dropped by the counts or by the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import bounded, table, written
from attestra.llm.words import mixed, word_names

U = np.uint64
#: Bytes that part the words of a piece, and bytes that part pieces.
BLANKS, STOPS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)], KIND[list(STOPS)] = 1, 2
FILTER_BITS = 25  # of a bitmap: 4 MB
RANK_BUCKETS = 64


class Tokens:
    """The words of some texts in order: ``data[first:last]``, ``name`` by language, ``joined`` with the next one in a piece."""

    def __init__(self, texts: list[bytes], langs: list[str], seed: int):
        joined = (b"\n".join(texts) + b"\n" * 9).lower()  # bytes: A-Z only
        self.data = np.frombuffer(joined, np.uint8)
        kind = KIND[self.data]
        word = kind == 0
        edge = np.flatnonzero(np.diff(word, prepend=False))
        self.first, self.last = edge[::2], edge[1::2]
        one, other = word_names(joined, self.first, self.last)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.text = np.searchsorted(begins, self.first, side="right") - 1
        salts = {x: xxhash.xxh3_64_intdigest(x.encode(), seed) for x in set(langs)}
        salt = np.array([salts[x] for x in langs], U)
        self.name = mixed(one ^ mixed(other + salt[self.text])) if len(one) else one
        stops = np.flatnonzero(kind == 2)
        self.joined = np.searchsorted(stops, self.first[1:]) == np.searchsorted(stops, self.last[:-1])

    def words(self, at: np.ndarray) -> pa.Array:
        """The words at some places, as they are."""
        size = self.last[at] - self.first[at]
        ends = np.cumsum(size)
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[at] - (ends - size), size)
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(self.data[places])])


def turned(name: np.ndarray) -> np.ndarray:
    return (name << U(1)) | (name >> U(63))


def phrase_name(names: list[Column]) -> Column:
    """The name of a phrase from those of its words, for bitmaps; ``phrase_names`` does the same."""
    out = names[0]
    for n in names[1:]:
        out = F.shiftleft(out, 1).bitwiseOR(F.shiftrightunsigned(out, 63)).bitwiseXOR(n)
    return out


def phrase_names(name: np.ndarray, k: int) -> np.ndarray:
    n = max(len(name) - k + 1, 0)
    out = name[:n]
    for j in range(1, k):
        out = turned(out) ^ name[j : j + n]
    return out


def bitmap(phrases: DataFrame, names: list[str]) -> Broadcast:
    """A bitmap of the phrases' names, broadcast: its size doesn't depend on their number."""
    name, spark = phrase_name([F.col(n) for n in names]), phrases.sparkSession
    place = name.bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    cells = phrases.select(place.alias("place")).groupBy(F.expr("cast(shiftright(place, 6) as int)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, cast(place & 63 as int)))").alias("bits"))
    found = cells.toArrow()
    bits = np.zeros(1 << (FILTER_BITS - 6), U)
    bits[found.column("cell").to_numpy()] = found.column("bits").to_numpy().view(U)
    return spark.sparkContext.broadcast(bits)


def within(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    place = name & U((1 << FILTER_BITS) - 1)
    return (bits[(place >> U(6)).astype(np.int64)] >> (place & U(63))) & U(1) != 0


def summed(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """First places and numbers of equal rows of keys; rows whose keys mix alike may give several parts of a sum."""
    mix = keys[0]
    for k in keys[1:]:
        mix = mixed(mix ^ turned(k))
    order = np.argsort(mix)
    if not len(order):
        return order, order
    differ = np.zeros(len(order), bool)
    differ[0] = True
    for k in keys:
        differ[1:] |= np.diff(k[order]) != 0
    at = np.flatnonzero(differ)
    return order[at], np.diff(np.append(at, len(order)))


def _lists(batch: pa.RecordBatch) -> tuple[list[bytes], list[str]]:
    return [x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()], batch.column(1).to_pylist()


def count_words(texts: DataFrame, seed: int) -> DataFrame:
    """``name, lang, word, n`` of every word of every language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = Tokens(*_lists(batch), seed)
            at, n = summed([tokens.name, (tokens.last - tokens.first).astype(U)])
            langs = batch.column(1).take(pa.array(tokens.text[at]))
            yield pa.RecordBatch.from_arrays([pa.array(tokens.name[at].view(np.int64)), langs, tokens.words(at), pa.array(n.astype(np.int64))], names=["name", "lang", "word", "n"])

    parts = texts.mapInArrow(bounded(count, 0), "name long, lang string, word string, n long")
    return parts.groupBy("name", "lang", "word").agg(F.sum("n").alias("n"))


def count_phrases(texts: DataFrame, k: int, below: Broadcast, seed: int) -> DataFrame:
    """``h1 .. hk, n``: how often names follow each other in a piece, where both halves may be frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = Tokens(*_lists(batch), seed)
            known = within(below.value, phrase_names(tokens.name, k - 1))
            ok = known[:-1] & known[1:]
            for j in range(k - 1):
                ok &= tokens.joined[j : j + len(ok)]
            start = np.flatnonzero(ok)
            keys = [tokens.name[start + j] for j in range(k)]
            at, n = summed(keys)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[at].view(np.int64)) for x in keys), pa.array(n.astype(np.int64))], names=[*_names(k), "n"])

    parts = texts.mapInArrow(bounded(count, 0), ", ".join(f"{c} long" for c in [*_names(k), "n"]))
    return parts.groupBy(*_names(k)).agg(F.sum("n").alias("n"))


def _names(k: int, start: int = 1) -> list[str]:
    return [f"h{i}" for i in range(start, start + k)]


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, max_words: int = 3) -> tuple[DataFrame, DataFrame]:
    """All phrases of 1 to ``max_words`` words that occur ``least`` times in a language, and the number of words of each language.

    Phrases: ``id, lang, k, phrase, a, left, right, lefts, rights, inside``: ``a`` occurrences,
    ``left`` and ``right`` the ids of the first and the last k - 1 words (null for words),
    ``lefts`` and ``rights`` the counts of the first and of the last part of each cut, in the
    order of cuts, ``inside`` the greatest count of a longer phrase that contains it (null:
    none). Numbers: ``lang, n``.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = docs.select(F.col(text_col).alias("text"), lang.alias("lang"))
    for seed in range(8):
        words = written(count_words(texts, seed), "words")
        shared = words.groupBy("name").agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")).where(f"words > 1 AND n >= {least}")
        if not shared.take(1):
            break
    else:
        raise RuntimeError("frequent words share a 64-bit name under every seed")
    none = F.array().cast("array<long>")
    level = words.where(F.col("n") >= least).select(
        F.monotonically_increasing_id().alias("id"), "lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), F.col("n").alias("a"),
        F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"), none.alias("lefts"), none.alias("rights"), F.col("name").alias("h1"),
    )
    level = written(level, "phrases-1")
    levels = [level]
    for k in range(2, max_words + 1):
        below = bitmap(level, _names(k - 1))
        counts = count_phrases(texts, k, below, seed).where(F.col("n") >= least)
        half = lambda side, start: level.select(*(F.col(a).alias(b) for a, b in zip(_names(k - 1), _names(k - 1, start), strict=True)), F.struct("id", "lang", "phrase", "a", "lefts", "rights").alias(side))  # noqa: B023, E731
        paired = counts.join(half("x", 1), _names(k - 1)).join(half("y", 2), _names(k - 1, 2))
        level = paired.select(
            (F.monotonically_increasing_id() + F.lit(k << 58)).alias("id"), "x.lang", F.lit(k).alias("k"),
            F.concat("x.phrase", F.lit(" "), F.substring_index("y.phrase", " ", -1)).alias("phrase"), F.col("n").alias("a"), F.col("x.id").alias("left"), F.col("y.id").alias("right"),
            F.array_append("x.lefts", F.col("x.a")).alias("lefts"), F.array_prepend("y.rights", F.col("y.a")).alias("rights"), *_names(k),
        )
        level = written(level, f"phrases-{k}")
        below.unpersist()
        levels.append(level)
    out = []
    for low, high in pairwise([*levels, None]):
        low = low.drop(*(c for c in low.columns if c[0] == "h" and c[1:].isdigit()))
        if high is None:
            out.append(low.withColumn("inside", F.lit(None).cast("long")))
            continue
        reach = high.select(F.explode(F.array("left", "right")).alias("id"), "a").groupBy("id").agg(F.max("a").alias("inside"))
        out.append(low.join(reach, "id", "left"))
    phrases = out[0]
    for more in out[1:]:
        phrases = phrases.unionByName(more)
    return phrases, words.groupBy("lang").agg(F.sum("n").alias("n"))


def best_cut() -> Column:
    """``score, cut, l, r`` of the cut that counts, from ``a, lefts, rights``. Products of counts may pass 64 bits."""
    exact = lambda c: c.cast("decimal(18,0)")
    return F.array_min(
        F.transform(
            F.arrays_zip("lefts", "rights"),
            lambda c, i: F.struct(F.call_function("div", 1_000_000 * exact(F.col("a")) * exact(F.col("a")), exact(c["lefts"]) * exact(c["rights"])).alias("score"), i.alias("cut"), c["lefts"].alias("l"), c["rights"].alias("r")),
        )
    )


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10, max_words: int = 3, top: int | None = 2000, share: int = 50) -> DataFrame:
    """Collocations of each language: ``lang, rank, phrase, a, l, r, n, score``, best first.

    Texts are lower-cased (A-Z only), cut into pieces at ``.,;:!?`` and line ends, and those
    into words at spaces and tabs. Phrases of 2 to ``max_words`` words with ``a`` >= ``least``
    occurrences, overlapping ones included, are candidates. Of the cuts into a first part
    (``l`` occurrences) and the rest (``r``) the one of the lowest score floor(10^6 a a / (l r))
    counts, of equal ones the first. Candidates inside a longer one with at least ``share``
    in 100 of their occurrences are dropped. ``n``: words of the language. ``top``: rows of a
    language, all if None.

    A null language counts as ``und``. Null and empty texts have no words, an empty table no
    rows; repeated rows count again. Other columns, whatever their names, are not read. A task
    holds one text and some 200 bytes for each of its words.
    """
    phrases, totals = frequent_phrases(docs, lang_col, text_col, least, max_words)
    held = phrases.where(F.col("k") > 1).where(F.col("inside").isNull() | (100 * F.col("inside") < share * F.col("a")))
    scored = held.select("lang", "phrase", "a", best_cut().alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    if top is not None:  # the first of each bucket of a language, then of those the first: no language meets in one task
        bucket = F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS)).alias("bucket")
        scored = scored.select("*", bucket).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top).drop("bucket", "rank")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
w AS (SELECT lang, regexp_extract_all(unnest(ps), '[^\x20\x09]+') AS ws FROM p),
g AS (
    SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(ws)), lambda i: array_to_string(ws[i : i + 1], ' '))) FROM w
    UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' '))) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
t AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cuts AS (SELECT lang, k, phrase, a, ws, array_to_string(ws[:j], ' ') AS x, array_to_string(ws[j + 1 :], ' ') AS y, j FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (
    SELECT cuts.*, fx.a AS l, fy.a AS r, (1000000::HUGEINT * cuts.a * cuts.a) // (fx.a::HUGEINT * fy.a) AS score
    FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x AND fx.k = j JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y AND fy.k = cuts.k - j),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inside AS (
    SELECT lang, phrase, max(a) AS longer FROM (
        SELECT lang, a, array_to_string(ws[1:2], ' ') AS phrase FROM c WHERE k = 3 UNION ALL SELECT lang, a, array_to_string(ws[2:3], ' ') FROM c WHERE k = 3) GROUP BY ALL),
r AS (
    SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, b.l, b.r, b.score::BIGINT AS score
    FROM b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase AND b.k = 2 WHERE i.longer IS NULL OR 100 * i.longer < 50 * b.a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM r JOIN t USING (lang) WHERE rank <= 2000
"""
