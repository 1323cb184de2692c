"""Language identification by rank-order profiles.

A profile is the ranking of the ``PROFILE`` most frequent n-grams (1 to 4 letters of each
lower-cased word, padded by ``_``; ties in code point order). A document goes to the
language whose profile is nearest in out-of-place distance: the sum of rank differences,
``PROFILE`` for an n-gram that the language's profile lacks. Languages are learned from
labelled documents, about ``sample_per_lang`` whole texts of each, drawn by a hash of the
id; with fewer labelled documents all of them. The drawing bounds the fit alone: every
document is predicted from its whole text.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from attestra.llm.common import bounded, table

PROFILE, LONGEST = 300, 4
WORDS = regex.compile(r"[\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
Profiles = dict[str, dict[str, int]]


def grams_of(word: str) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for n in range(1, LONGEST + 1) for i in range(len(padded) - n + 1) if n > 1 or padded[i] != "_"]


class Ranker:
    """Languages' profiles over the union of their n-grams, and the nearest one to a text.

    A text is ranked by all its n-grams; those that no profile has keep their places in the
    ranking. They are counted over the text's words, joined by ``_``, as numbers of four digits,
    one a letter in code point order and 0 for none, so that order of numbers is order of names.
    The most frequent ones are then found in the profiles by a trie.
    """

    def __init__(self, profiles: Profiles):
        self.langs = sorted(profiles)
        grams = sorted(set().union(*profiles.values()))
        place = {g: i for i, g in enumerate(grams)}
        self.ranks = np.full((len(self.langs), len(grams) + 1), -1, np.int64)  # the last place is no profile's n-gram
        for k, lang in enumerate(self.langs):
            for g, r in profiles[lang].items():
                self.ranks[k, place[g]] = r
        letters = sorted(set("".join(grams)))
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        states = {"": 1}  # state 0 leads nowhere
        for g in grams:
            for i in range(1, len(g) + 1):
                states.setdefault(g[:i], len(states) + 1)
        self.step = np.zeros((len(states) + 1, len(letters) + 1), np.int32)
        self.gram = np.full(len(states) + 1, len(grams), np.int64)
        for g, state in states.items():
            if g:
                self.step[states[g[:-1]], self.letter[ord(g[-1])]] = state
                self.gram[state] = place.get(g, len(grams))

    def ranking(self, text: str) -> np.ndarray:
        """The most frequent n-grams in order, ties by name: their places in the profiles' union."""
        joined = f"_{'_'.join(WORDS.findall(text.lower()))}_"
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        present = np.bincount(points) > 0
        letters = np.flatnonzero(present)
        digits = np.cumsum(present)[points].astype(np.uint64)
        width = np.uint64(int(len(letters)).bit_length())
        if width * np.uint64(LONGEST) > 64:  # more than 65,535 different letters
            return self._plain_ranking(text)
        mark = points == ord("_")
        # an n-gram has no mark inside; one letter alone is no mark
        found, key, whole = [], np.zeros(len(digits), np.uint64), np.ones(len(digits), bool)
        for n in range(LONGEST):
            size = max(len(digits) - n, 0)
            key = (key[:size] << width) | digits[n:]
            whole = whole[:size] if n < 2 else whole[:size] & ~mark[n - 1 : n - 1 + size]
            found.append(key[whole & ~mark if n == 0 else whole] << width * np.uint64(LONGEST - 1 - n))
        names, counts = np.unique(np.concatenate(found), return_counts=True)
        names = names[np.argsort(-counts, kind="stable")[:PROFILE]]
        state = np.ones(len(names), np.int32)
        for n in range(LONGEST):
            digit = ((names >> width * np.uint64(LONGEST - 1 - n)) & ((np.uint64(1) << width) - np.uint64(1))).astype(np.int64)
            state = np.where(digit > 0, self.step[state, self.letter[letters[digit - 1]]], state)
        return self.gram[state]

    def _plain_ranking(self, text: str) -> np.ndarray:
        counts: Counter = Counter()
        for word, n in Counter(WORDS.findall(text.lower())).items():
            for g in grams_of(word):
                counts[g] += n
        found = []
        for g in sorted(counts, key=lambda g: (-counts[g], g))[:PROFILE]:
            state = 1
            for c in g:
                state = self.step[state, self.letter[ord(c)]]
            found.append(self.gram[state])
        return np.array(found, np.int64)

    def nearest(self, text: str) -> tuple[str, float]:
        """The nearest language, ties by name, and 1 less its distance as a part of the greatest possible."""
        order = self.ranking(text)
        if not len(order):
            return self.langs[0], 0.0
        ranks = self.ranks[:, order]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(order)))).sum(axis=1)
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (PROFILE * len(order))


def learn_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_lang: int = 1000) -> Profiles:
    """Profiles of the languages of ``labelled``; rows with a null label or text are left out."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    rate = F.lit(None).cast("double")
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, min(1.0, sample_per_lang / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for word, n in Counter(WORDS.findall(text.lower())).items():
                    for g in grams_of(word):
                        own[lang][g] += n
        for lang, counts in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])

    counts = rows.where(draw < rate).select("lang", "text").mapInArrow(bounded(count, 1), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= PROFILE)
    profiles: Profiles = {}
    for r in ranked.collect():  # languages x PROFILE rows
        profiles.setdefault(r["lang"], {})[r["gram"]] = r["rank"] - 1
    return profiles


def identify(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: ``doc_id, lang_pred, score, rejected``, after them the columns named in ``keep`` as ``k_...``.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or where
    nothing was learned; ``rejected`` tells the first case alone. Repeated and null ids pass through.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranker = Ranker(profiles) if profiles else None
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                rejected = not text or not LETTER.search(text)
                found.append((*(("und", 0.0) if rejected or not ranker else ranker.nearest(text)), rejected))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_()), *batch.columns[2:]], names=["doc_id", "lang_pred", "score", "rejected", *(f"k_{c}" for c in keep)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *(F.col(c).alias(f"k_{c}") for c in keep))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(bounded(predict, 1), ", ".join(["doc_id long, lang_pred string, score double, rejected boolean", *(f"k_{c} {kinds[f'k_{c}']}" for c in keep)]))


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5: documents at 0 are held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = learn_profiles(docs.where(fold() != 0))
    return identify(docs, profiles).select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")
