"""Removal of long repeated passages by recompression.

Recompression rewrites a text in rounds: runs of one word become one symbol, then pairs of
neighbouring symbols do, a symbol's hash bit telling whether it can be a left or a right
half. Names are hashes of what they stand for, so all executors name alike, and equal
passages get equal symbols but at their rims. For each symbol the code keeps the stretch
of words on which its existence depends; a window that holds that stretch whole holds the
symbol in every text. Each window of ``window`` words so has an anchor that depends on its
own words only: of the symbols certain in it at the highest level that has any, the one
with the least name. Windows side by side with one anchor are one row: about one row for
12 words.

1. Rows whose anchor name occurs once in the corpus are done: no repeat there.
2. Of the others, rows of equal name and equal stretch of words (128 bits together) are
   repeats in all their windows.
3. Names that come with different stretches are verified window by window: one row of each
   stretch is read again and its windows' fingerprints counted under the name (128 bits
   together), with the number of rows they stand for. This decides which windows repeat.
4. Each document drops the words that its repeated windows cover.

All steps are keyed joins and pre-aggregated counts: a passage in a third of all documents is
counted by parts, and its rows are joined with the count where they are. The names are made
of two independent 64-bit names of each word (``words.py``); name and stretch, or name and
fingerprint, use one of them each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import bounded, drop_written, join_uses, table, written
from attestra.llm.words import BASES, Slots, chained, mixed, stretch_names

ROUNDS = 4
BATCH_BYTES = 600_000
BROADCAST_ROWS = 400_000
U = np.uint64


def parse(slots: Slots) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each level the names and the stretches ``low, high`` of slots that they depend on, separators left out."""
    n = len(slots.hash)
    name, low, sep = slots.hash.copy(), np.arange(n), slots.separator.copy()
    high = low + 1
    levels = [(name[~sep], low[~sep], high[~sep])]
    for r in range(ROUNDS):
        if r == 0:  # runs of a word; that a run ends depends on its neighbours
            new = np.ones(len(name), bool)
            new[1:] = name[1:] != name[:-1]
            start = np.flatnonzero(new)
            end = np.append(start[1:], len(name))
            run = (end - start).astype(U)
            low, high = np.maximum(low[start] - 1, 0), np.minimum(high[end - 1] + 1, n)
            with np.errstate(over="ignore"):
                name = np.where(run > 1, mixed(name[start] + mixed(run + U(5))), name[start])
            sep = sep[start]
        left = (mixed(name + U(1000 * r + 99)) >> U(40)) & U(1) == 0
        right = ~left & ~sep
        left &= ~sep
        joins = np.zeros(len(name), bool)
        joins[:-1] = left[:-1] & right[1:]
        joined = np.zeros(len(name), bool)
        joined[1:] = joins[:-1]
        new_low, new_high = low.copy(), high.copy()
        # A symbol that joins depends on both halves, one that doesn't on the neighbour it might have joined.
        i = np.flatnonzero(joins | (left & ~joined))
        i = i[i < len(name) - 1]
        new_low[i], new_high[i] = np.minimum(low[i], low[i + 1]), np.maximum(high[i], high[i + 1])
        i = np.flatnonzero(right & ~joined)
        i = i[i > 0]
        new_low[i], new_high[i] = np.minimum(low[i], low[i - 1]), np.maximum(high[i], high[i - 1])
        i = np.flatnonzero(joins)
        with np.errstate(over="ignore"):
            name[i] = mixed(name[i] * U(3) + mixed(name[i + 1] + U(77 * r + 1)))
        keep = ~joined
        name, low, high, sep = name[keep], new_low[keep], new_high[keep], sep[keep]
        levels.append((name[~sep], low[~sep], high[~sep]))
    return levels


def anchored_rows(texts: list[bytes], window: int) -> tuple[np.ndarray, ...]:
    """Rows ``text, first window, windows, name, stretch, self``; ``self``: more than one occurrence of the anchor."""
    slots = Slots(texts)
    n = len(slots.hash)
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, U, U, bool))
    if n < window:
        return none
    seps = np.concatenate([[0], np.cumsum(slots.separator)])
    at = np.arange(n - window + 1)
    valid = seps[at + window] == seps[at]
    open_ = valid.copy()
    name_of, occurrence, base = np.zeros(len(at), U), np.full(len(at), -1), 0
    stretch_of = stretch_names(slots.hash, BASES[0])
    for level, (name, low, high) in reversed(list(enumerate(parse(slots)))):
        if not open_.any():
            break
        a, b = np.maximum(high - window, 0), np.minimum(low, n - window)
        some = np.flatnonzero(b >= a)
        a, size = a[some], (b - a)[some] + 1
        symbol = np.repeat(some, size)
        where = np.arange(len(symbol)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        inside = open_[where]
        symbol, where = symbol[inside], where[inside]
        with np.errstate(over="ignore"):
            names = mixed(name[symbol] + U(4242 + level))
        least = np.full(len(at), np.iinfo(U).max, U)
        np.minimum.at(least, where, names)
        chosen = names == least[where]
        symbol, where = symbol[chosen][::-1], where[chosen][::-1]
        # Named by all words that the symbol depends on: they are in the window, and rare where they don't repeat.
        with np.errstate(over="ignore"):
            full = mixed(stretch_of(low[some], high[some]) + mixed(name[some] + U(level)))
        place = np.zeros(len(name), np.int64)
        place[some] = np.arange(len(some))
        name_of[where], occurrence[where] = full[place[symbol]], base + symbol  # the leftmost is written last
        open_[where] = False
        base += len(name)
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (name_of[1:] != name_of[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return none
    gone = valid.copy()
    gone[:-1] &= ~valid[1:] | (name_of[1:] != name_of[:-1])
    last = np.flatnonzero(gone)
    changes = np.concatenate([[0, 0], np.cumsum(occurrence[1:] != occurrence[:-1])])[: len(at) + 1]
    several = changes[last + 1] != changes[first + 1]
    stretch = stretch_names(slots.other, BASES[1])(first, last + window)
    text = np.searchsorted(slots.begin, first, side="right") - 1
    return text, first - slots.begin[text], last - first + 1, name_of[first], stretch, several


def window_prints(text: bytes, first: np.ndarray, count: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each wanted window the row it is of and its fingerprint."""
    slots = Slots([text])
    row = np.repeat(np.arange(len(first)), count)
    first = first + slots.begin[0]
    p = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    return row, chained(slots.other, window)[p]


def _encoded(values: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a column in parts of about ``BATCH_BYTES``, with the place of the first."""
    part, size, at = [], 0, 0
    for i, t in enumerate(values.to_pylist()):
        part.append((t or "").encode())
        size += len(part[-1])
        if size >= BATCH_BYTES:
            yield at, part
            part, size, at = [], 0, i + 1
    if part:
        yield at, part


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _only(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows with (``left_semi``) or without (``left_anti``) their id in ``ids``: without a shuffle of texts while ids are few."""
    few = ids.count() <= BROADCAST_ROWS
    ids = ids.toDF("o_id", "o_tag")
    return rows.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("tag") == F.col("o_tag")), how)


def repeated_windows(rows: DataFrame, window: int) -> DataFrame:
    """Intervals of repeated windows of ``rows`` (``doc_id, tag, text``): ``doc_id, tag, first, last``."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column(0), batch.column(1)
            for at, texts in _encoded(batch.column(2)):
                text, first, count, name, stretch, several = anchored_rows(texts, window)
                which = pa.array(text + at)
                yield pa.RecordBatch.from_arrays(
                    [_signed(name), _signed(stretch), ids.take(which), tags.take(which), pa.array(first, pa.int32()), pa.array(count, pa.int32()), pa.array(several)],
                    names=["name", "stretch", "doc_id", "tag", "first", "n", "several"],
                )

    found = written(rows.mapInArrow(bounded(anchors, 2), "name long, stretch long, doc_id long, tag long, first int, n int, several boolean"), "anchors")
    names = found.groupBy("name").agg(F.count(F.lit(1)).alias("uses"), F.max("several").alias("any")).where("uses > 1 OR any").select("name")
    shared = written(found.join(names, "name", "left_semi"), "shared-anchors")
    drop_written(found)
    kinds = written(shared.groupBy("name").agg(((F.min("stretch") != F.max("stretch")) | F.max("several")).alias("open"), F.count(F.lit(1)).alias("uses")), "kinds")
    known = written(join_uses(shared, kinds, ["name"], "uses").select("name", "stretch", "doc_id", "tag", "first", "n", "open"), "known-anchors")
    drop_written(shared), drop_written(kinds)
    whole = known.where("NOT open").select("doc_id", "tag", "first", (F.col("first") + F.col("n") - 1).alias("last"))
    some = known.where("open")

    # Windows of one row of each stretch that needs a closer look.
    stretches = some.groupBy("name", "stretch").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("doc_id", "tag", "first", "n")).alias("one"))
    asked = stretches.groupBy(F.col("one.doc_id").alias("a_id"), F.col("one.tag").alias("a_tag")).agg(F.collect_list(F.struct("name", "stretch", F.col("one.first").alias("first"), F.col("one.n").alias("n"), "uses")).alias("asks"))  # within one document
    asked = written(asked, "asked")
    joined = _only(rows, asked.select("a_id", "a_tag"), "left_semi").join(asked, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("tag") == F.col("a_tag"))).select("text", "asks")

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(4)]
            asks = batch.column(1)
            flat, cuts = asks.flatten(), np.concatenate([[0], np.cumsum(asks.value_lengths().to_numpy(zero_copy_only=False))])
            name, stretch, first, n, uses = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(5))
            for i, text in enumerate(batch.column(0).to_pylist()):
                own = slice(cuts[i], cuts[i + 1])
                row, print_ = window_prints(text.encode(), first[own].astype(np.int64), n[own].astype(np.int64), window)
                place = np.arange(len(row)) - np.searchsorted(row, row)
                for k, x in enumerate((name[own][row], print_.view(np.int64), stretch[own][row], place << 32 | np.minimum(uses[own][row], 2))):
                    out[k].append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["name", "print", "stretch", "at"])

    # Equal windows have one anchor name, so that name and fingerprint together are 128 bits.
    prints_ = written(joined.mapInArrow(bounded(prints, 0), "name long, print long, stretch long, at long"), "prints")
    counts = prints_.groupBy("name", "print").agg(F.sum(F.col("at").bitwiseAND(3)).alias("uses"), F.count(F.lit(1)).alias("rows"))
    again = join_uses(prints_, written(counts.where("uses > 1"), "counts"), ["name", "print"], "rows").select("name", "stretch", F.shiftright("at", 32).cast("int").alias("place"))
    places = again.groupBy("name", "stretch").agg(F.sort_array(F.collect_set("place")).alias("places"))  # within one row
    # Places side by side as intervals.
    begins = F.filter(F.col("places"), lambda p: ~F.array_contains("places", p - 1))
    ends = F.filter(F.col("places"), lambda p: ~F.array_contains("places", p + 1))
    spans = places.select("name", "stretch", F.explode(F.arrays_zip(begins.alias("b"), ends.alias("e"))).alias("s")).select("name", "stretch", F.col("s.b").alias("b"), F.col("s.e").alias("e"))
    partly = some.join(spans, ["name", "stretch"]).select("doc_id", "tag", (F.col("first") + F.col("b")).alias("first"), (F.col("first") + F.col("e")).alias("last"))
    return whole.unionByName(partly)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, outputs: tuple[str, ...] = ("n_words", "n_removed", "kept_text")) -> DataFrame:
    """One row per input row: ``doc_id`` and the ``outputs`` among ``n_words, n_removed, kept_text, kept_sha256, spans``.

    A word goes when a window of ``window`` consecutive words that covers it has a word
    sequence that also starts anywhere else, in the same document too; windows are judged
    on the input. ``kept_text`` has the remaining words joined by one space, ``spans`` the
    removed stretches as first and last word. Null text has no words; texts shorter than a
    window keep all. Rows that repeat an id are texts of their own, so that two equal rows
    repeat each other. An empty table gives an empty result. Other columns are not read.
    """
    ids = docs.select(F.col(id_col).cast("long").alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    tag = F.xxhash64(F.col(text_col)) if ids.where("n > 1").take(1) else F.lit(0).cast("long")  # tells rows of one id apart
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), tag.alias("tag"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = repeated_windows(rows, window).groupBy(F.col("doc_id").alias("s_id"), F.col("tag").alias("s_tag")).agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    spans = written(spans, "spans")
    kinds = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_text": pa.string(), "kept_sha256": pa.string(), "spans": pa.list_(pa.list_(pa.int32()))}
    names = {"n_words": "long", "n_removed": "long", "kept_text": "string", "kept_sha256": "string", "spans": "array<array<int>>"}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {o: [] for o in outputs}
            lists = batch.column(2)
            flat, cuts = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            first, last = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = text.encode().split()  # at the same six characters
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, first[cuts[i] : cuts[i + 1]], 1)
                np.add.at(edge, last[cuts[i] : cuts[i + 1]] + window, -1)
                covered = np.cumsum(edge)[:-1] > 0
                kept = b" ".join(compress(words, (~covered).tolist())) if cuts[i + 1] > cuts[i] else b" ".join(words)
                values = {"n_words": len(words), "n_removed": int(covered.sum()), "kept_text": kept, "kept_sha256": None, "spans": None}
                if "kept_sha256" in out:
                    values["kept_sha256"] = hashlib.sha256(kept).hexdigest()
                if "kept_text" in out:
                    values["kept_text"] = kept.decode()
                if "spans" in out:
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                    values["spans"] = [[int(a), int(b) - 1] for a, b in zip(turns[::2], turns[1::2], strict=True)]
                for o in outputs:
                    out[o].append(values[o])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[o], kinds[o]) for o in outputs)], names=["doc_id", *outputs])

    ids = spans.select("s_id", "s_tag")
    touched = _only(rows, ids, "left_semi").join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tag") == F.col("s_tag"))).select("doc_id", "text", "spans")
    others = _only(rows, ids, "left_anti").select("doc_id", "text", F.lit(None).cast(spans.schema["spans"].dataType).alias("spans"))
    schema = ", ".join(["doc_id long", *(f"{o} {names[o]}" for o in outputs)])
    return touched.mapInArrow(bounded(cut, 1), schema).unionByName(others.mapInArrow(bounded(cut, 1), schema))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), outputs=("n_words", "n_removed", "kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
     k AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS m FROM p),
     r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY m) AS c FROM k) WHERE c > 1),
     c AS (SELECT doc_id, list(DISTINCT x) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS x FROM r) GROUP BY doc_id),
     e AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS x FROM w),
     g AS (SELECT doc_id, unnest(gone) AS x, true AS gone FROM c),
     f AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS kept, count(*) AS n FROM e ANTI JOIN g USING (doc_id, x) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN f ON f.doc_id = w.doc_id
"""
