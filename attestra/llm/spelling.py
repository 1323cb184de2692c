"""Spelling variants: words at one edit from each other, found by automata over broadcast trie shards.

The vocabulary is cut into shards of at most ``SHARD_WORDS`` words, by ranges of the words and
again by ranges of the reversed words. One shard after another becomes a compact trie and is
broadcast, some ten bytes for each of its nodes, and its pairs are written. Every word's automaton for one edit walks it depth-first: a stack of states (place in the
word, trie node, edit spent or not), worked off in blocks by numpy for a batch of words at a time.

A pair that differs by one edit has the edit after the middle of the word or before it. The
forward tries answer for the first case: the automaton may spend its edit only after the
word's first half, so that it goes straight down to where few branches are left; the tries
of reversed words answer for the second case. A word is sent only to shards whose range holds words that begin with
the half it must follow; no other shard has a state that the automaton could reach. Every
pair is so found once in each direction; pairs are reduced to counts and the best form by sums.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import bounded, table, written

RUN = re.compile("[a-zÀ-ÿ]+")  # of texts whose A-Z are lower-cased
SHARD_WORDS = 400_000
BATCH_WORDS, BLOCK_STATES = 4_096, 1 << 17
HELD_WORDS = 200_000  # distinct words that a task counts before it hands them on


class Trie:
    """A trie of sorted words as arrays: nodes in order of depth, so that a node's children lie side by side.

    ``label[i]`` is the last letter of node ``i``, ``child[i]:child[i + 1]`` are its children,
    ``word[i]`` the number of the word that ends there, or -1.
    """

    def __init__(self, words: list[str]):
        joined = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        size = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(size) - size
        label, child, word = [np.zeros(1, np.uint8)], [], [np.full(1, -1, np.int32)]
        nodes, depth = 1, 0
        alive, at = np.arange(len(words)), np.zeros(len(words), np.int64)  # words that go on, and their nodes
        while len(alive):
            letter = joined[begin[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (np.diff(at) != 0) | (np.diff(letter) != 0)
            first = np.flatnonzero(new)
            parents = np.arange(nodes - len(word[-1]), nodes)
            child.append(nodes + np.searchsorted(at[first], parents))
            label.append(letter[first])
            node = nodes + np.cumsum(new) - 1
            nodes += len(first)
            depth += 1
            done = size[alive] == depth
            ends = np.full(len(first), -1, np.int32)
            ends[node[done] - (nodes - len(first))] = alive[done]
            word.append(ends)
            alive, at = alive[~done], node[~done]
        child.append(np.full(len(word[-1]) + 1, nodes))
        self.label, self.child, self.word = np.concatenate(label), np.concatenate(child).astype(np.int32), np.concatenate(word)
        self.key = np.repeat(np.arange(nodes, dtype=np.int64), np.diff(self.child)) << 8 | self.label[1:]  # parent and letter of each node but the root

    def next(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, or -1."""
        key = node.astype(np.int64) << 8 | letter
        at = np.searchsorted(self.key, key)
        found = at < len(self.key)
        found[found] = self.key[at[found]] == key[found]
        return np.where(found, at + 1, -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All children of some nodes: places in ``node``, and the children."""
        n = self.child[node + 1] - self.child[node]
        of = np.repeat(np.arange(len(node)), n)
        return of, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.child[node][of]

    def near(self, words: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``words``, number of a word of the trie) at distance one, the edit after the first ``exact`` letters."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.append(np.frombuffer("".join(words).encode("latin-1"), np.uint8), 0)
        begin = np.cumsum(size) - size
        stack = [(np.arange(len(words)), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), bool))]
        pairs = []
        while stack:
            q, node, at, spent = stack.pop()
            if len(q) > BLOCK_STATES:
                stack.append(tuple(x[BLOCK_STATES:] for x in (q, node, at, spent)))
                q, node, at, spent = (x[:BLOCK_STATES] for x in (q, node, at, spent))
            ended = at == size[q]
            hit = ended & spent & (self.word[node] >= 0)
            pairs.append((q[hit], self.word[node[hit]]))
            # With the same letter: one state each.
            go = np.flatnonzero(~ended)
            to = self.next(node[go], letters[begin[q[go]] + at[go]])
            go, to = go[to >= 0], to[to >= 0]
            out = [(q[go], to, at[go] + 1, spent[go])]
            # With the edit: a letter of the word goes, a letter of the trie comes, or one for the other.
            free = np.flatnonzero(~spent & (at >= exact[q]))
            if len(free):
                less = free[~ended[free]]
                out.append((q[less], node[less], at[less] + 1, np.ones(len(less), bool)))
                of, to = self.children(node[free])
                of = free[of]
                out.append((q[of], to, at[of], np.ones(len(of), bool)))
                other = ~ended[of]
                other[other] = letters[begin[q[of[other]]] + at[of[other]]] != self.label[to[other]]
                of, to = of[other], to[other]
                out.append((q[of], to, at[of] + 1, np.ones(len(of), bool)))
            state = tuple(np.concatenate(x) for x in zip(*out, strict=True))
            if len(state[0]):
                stack.append(state)
        total = len(self.word) + 1
        found = np.unique(np.concatenate([a * total + b for a, b in pairs])) if pairs else np.zeros(0, np.int64)
        return found // total, found % total


def count_forms(docs: DataFrame, id_col: str, text_col: str, min_length: int, change: int) -> DataFrame:
    """``word, n``: the words of all texts, one letter less where the checksum of id and word is divisible by ``change``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for key, text in zip(batch.column(1).to_pylist(), batch.column(0).cast(pa.binary()).to_pylist(), strict=True):
                seed = zlib.crc32(f"{key}:".encode())
                for word, n in Counter(RUN.findall(text.lower().decode())).items():  # bytes: A-Z only
                    if len(word) < min_length:
                        continue
                    if change and (h := zlib.crc32(word.encode(), seed)) % change == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < min_length:
                            continue
                    held[word] += n
                if len(held) > HELD_WORDS:
                    yield out()
        yield out()

    texts = docs.select(F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id")).where("text IS NOT NULL")
    return texts.mapInArrow(bounded(count, 0), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def near_words(vocabulary: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``word, near, near_n`` of every ordered pair of words that differ by one inserted, deleted or replaced letter.

    ``vocabulary``: distinct ``word``, ``n``; letters up to U+00FF, two at least.
    """
    spark = vocabulary.sparkSession
    shards = max(1, -(-vocabulary.count() // shard_words))
    found = [vocabulary.where("false").select("word", F.col("word").alias("near"), F.col("n").alias("near_n"))]
    for way in ("forward", "backward"):
        key = F.col("word") if way == "forward" else F.reverse("word")
        ranged = vocabulary.select(key.alias("key"), "n").repartitionByRange(shards, "key").sortWithinPartitions("key")
        ranged = written(ranged.withColumn("part", F.spark_partition_id()), f"vocabulary-{way}")
        half = F.expr("left(key, int(length(key) / 2))" if way == "forward" else "left(key, int((length(key) + 1) / 2))")
        for first, last, least, most in _shards(ranged, shard_words):
            part = ranged.where(F.col("part").between(first, last)).sort("key").toArrow()
            trie = spark.sparkContext.broadcast((Trie(part.column("key").to_pylist()), part))  # of a bounded number of words
            # The words that begin with a word's half are those from the half up to the half followed by the last letter.
            reach = ranged.where((half <= most) & (F.concat(half, F.lit("Ā")) >= least))
            found.append(written(reach.select("key", "n").mapInArrow(_search(trie, way), "word string, near string, near_n long"), "near"))
            trie.destroy()
    return reduce(DataFrame.unionByName, found)


def _shards(ranged: DataFrame, shard_words: int) -> list[tuple[int, int, str, str]]:
    """Shards of neighbouring ranges, filled up to ``shard_words``: first and last range, least and greatest key."""
    shards: list[tuple[int, int, str, str]] = []
    room = 0
    for r in ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("most")).sort("part").collect():  # a row for each range
        if shards and r["n"] <= room:
            shards[-1] = (shards[-1][0], r["part"], shards[-1][2], r["most"])
            room -= r["n"]
        else:
            shards.append((r["part"], r["part"], r["least"], r["most"]))
            room = shard_words - r["n"]
    return shards


def _search(shard: Broadcast, way: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, part = shard.value
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH_WORDS):
                words = batch.column(0).slice(i, BATCH_WORDS).to_pylist()
                size = np.fromiter(map(len, words), np.int64, len(words))
                own, other = trie.near(words, size // 2 if way == "forward" else (size + 1) // 2)
                near = part.column("key").take(pa.array(other)).to_pylist()
                n = part.column("n").take(pa.array(other)).combine_chunks()
                rows = [(words[a], b) for a, b in zip(own.tolist(), near, strict=True)]
                if way == "backward":  # those with equal halves are found forward
                    rows = [(a[::-1], b[::-1]) for a, b in rows]
                    apart = np.fromiter((a[: len(a) // 2] != b[: len(a) // 2] for a, b in rows), bool, len(rows))
                    rows, n = [r for r, x in zip(rows, apart, strict=True) if x], n.filter(pa.array(apart))
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string()), n if isinstance(n, pa.Array) else n.combine_chunks()], names=["word", "near", "near_n"])

    return search


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words of ``word, form``: where their forms, and those of the forms, end. Each round doubles the way."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = now.join(further, "root", "left")
        after = written(joined.select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        now = after.drop("moved")
        if not after.where("moved").take(1):
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, least: int = 5, factor: int = 5, change: int = 199, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row for each word: ``word, n, n_near, form, form_n, root``.

    Words are the maximal runs of ``[A-Za-zÀ-ÿ]``, A-Z lower-cased, of ``min_length`` letters
    and ``least`` occurrences at least. Before they are counted, a run loses one letter where
    ``change`` divides the checksum of ``<id>:<run>`` (0: never). Words are near if one edit
    parts them: a letter inserted, deleted or replaced. ``n_near`` counts them; ``form`` is the
    one of the most occurrences, ``form_n``, of equal ones the first in code-point order, if
    it has ``factor`` times the word's own; else null. ``root``: where the forms end, the word
    itself if it has none.

    Null and empty texts have no words, an empty table no rows; repeated rows count again. A
    null id counts as the text ``None``. Other columns, whatever their names, are not read. A
    task holds one text and its words.
    """
    vocabulary = written(count_forms(docs, id_col, text_col, min_length, change).where(F.col("n") >= least), "vocabulary")
    best = near_words(vocabulary, shard_words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("b"))
    good = -F.col("b.less") >= factor * F.col("n")
    formed = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("b.near")).alias("form"), F.when(good, -F.col("b.less")).alias("form_n"))
    formed = written(formed, "forms")
    return formed.join(roots(formed.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents),
d AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 6 GROUP BY ALL),
bytes AS (
    SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, 'None') || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c)::BIGINT - 64] END)) AS bs FROM d),
crc AS (
    SELECT w, n, xor(4294967295, list_reduce(bs, lambda c, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT)) AS h FROM bytes),
made AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM crc),
v AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
gone AS (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (
    SELECT a.word, b.word AS near, b.n AS near_n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT gone.word, v.word, v.n FROM gone JOIN v ON v.word = rest
    UNION SELECT v.word, gone.word, gone.n FROM gone JOIN v ON v.word = rest),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS most FROM p GROUP BY word),
f AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN most END AS form_n, CASE WHEN most >= 5 * v.n THEN (SELECT min(near) FROM p WHERE p.word = v.word AND near_n = most) END AS form
    FROM v LEFT JOIN b ON b.word = v.word),
r AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root AND f.form IS NOT NULL),
ends AS (SELECT r.word, r.root FROM r JOIN f ON f.word = r.root AND f.form IS NULL)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, coalesce(ends.root, f.word) AS root FROM f LEFT JOIN ends ON ends.word = f.word
"""
