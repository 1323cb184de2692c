"""Deduplication, similarity join, search, mixing, sharding and the pipeline against brute force."""

from __future__ import annotations

import collections
import hashlib
import importlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from attestra.llm import components as graph
from attestra.llm import exact_dedup, jaccard_join, mixing, sharding, substring_dedup, topk_search
from attestra.llm.common import UPPER, LOWER

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str | None) -> str:
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def sentence(r: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def mixed_rows() -> list[tuple]:
    """Copies, near copies, shared passages, runs, short, empty, null and long texts, in odd case."""
    r = random.Random(7)
    passage = sentence(r, 60)
    texts: list[str | None] = [None, "", " \n", "One", "one", "Two words", "two words", "a b c d", "A b c d e", "a b c d e f"]
    texts += ["rep " * 80, "rep " * 50, "x y " * 40, "x y " * 60, "p q r " * 30 + passage]
    for n in (6, 7, 8, 9, 12, 15, 20, 33, 50, 80, 140, 300, 700):
        base = sentence(r, n, 5000).split()
        texts.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            for _ in range(r.randint(0, max(1, n // 25))):
                kind, at = r.randrange(3), r.randrange(len(near))
                if kind == 0:
                    near[at] = f"z{r.randrange(999)}"
                elif kind == 1 and len(near) > 1:
                    del near[at]
                else:
                    near.insert(at, "more")
            texts.append((" " if r.random() < 0.5 else "\t").join(near))
        texts.append(" ".join(base).upper())
    for _ in range(15):
        texts.append(sentence(r, r.randint(1, 90), 5000) + "\n" + passage + " " + sentence(r, r.randint(0, 60), 5000))
    texts.append(sentence(r, 15_000, 8000) + " " + passage)
    texts.append(sentence(r, 40, 9000) + "é" + "ÀÉ" * 5)
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(10 * k, texts[i], ["b", "a", None][k % 3], "clash", 5) for k, i in enumerate(order)]


SCHEMA = "doc_id long, text string, source string, keep_id string, size int"


@pytest.fixture(scope="module")
def docs(spark, mixed_rows):
    return spark.createDataFrame(mixed_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(docs, mixed_rows, weak):
    groups = collections.defaultdict(list)
    for i, t, *_ in mixed_rows:
        groups[lower(t)].append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs, min_chunk=64, max_chunk=256, weak_digest=weak).collect()}
    assert len(got) == len(mixed_rows)
    for text, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_of_repeated_and_null_ids(spark, none):
    rows = [(1, "a b"), (1, "A b"), (2, None), (None, ""), (None, "c")]
    got = sorted(map(tuple, exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == sorted([(1, 1, 2, True), (1, 1, 2, True), (2, 2, 2, True), (None, 2, 2, False), (None, None, 1, True)], key=str)
    assert exact_dedup.exact_dedup(none).count() == 0


def shingles(text: str | None) -> frozenset:
    words = WORD.findall(lower(text))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_components(rows: list[tuple]) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t, *_ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components(docs, mixed_rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == brute_components(mixed_rows)


def test_jaccard_in_hot_batches(docs, mixed_rows, monkeypatch):
    """Buckets reduced to a batch's leader lose no link. In this process: the batch functions are called here."""
    monkeypatch.setattr(jaccard_join, "HOT", 1)
    r = random.Random(3)
    base = sentence(r, 120, 5000).split()
    texts = [" ".join(base[:k] + [f"q{k}"] + base[k + 1 :]).encode() for k in range(0, 120, 4)]
    sets = jaccard_join.Sets(texts, 0)
    rows = list(jaccard_join._batch_rows([jaccard_join._gathered(sets)], 4))
    pairs = {(int(a), int(b)) for p in range(4) for rb in jaccard_join._close([d for q, d in rows if q == p]) for a, b, c in zip(*(rb.column(i).to_pylist() for i in range(3)), strict=True) if c == jaccard_join.ALWAYS}
    near = collections.defaultdict(set)
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    seen, todo = set(), [int(sets.node[0])]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += near[x]
    assert seen >= set(map(int, sets.node))


@pytest.mark.parametrize("seed", range(4))
def test_no_pair_of_sets_is_missed(seed):
    """Each linked pair shares a signature, or one of them has too few units (and then a least token)."""
    r = random.Random(seed)
    for n in [*range(2, 40), 60, 71, 72, 90, 107, 200]:
        base = [f"u{r.randrange(10**9)}" for _ in range(n + 4)]
        other = list(base)
        for _ in range(r.randint(1, max(1, n // 18))):
            at = r.randrange(len(other))
            other[at : at + r.randint(0, 1)] = [f"v{r.randrange(10**9)}"] * r.randint(0, 1)
        texts = [" ".join(base), " ".join(other)]
        a, b = map(shingles, texts)
        if 100 * len(a & b) < 75 * len(a | b) or a == b:
            continue
        sets = jaccard_join.Sets([t.encode() for t in texts], seed)
        sign, text, _, _, spare = jaccard_join.signatures(sets)
        met = set(sign[text == 0].tolist()) & set(sign[text == 1].tolist())
        if not met:
            small = int(np.argmin(sets.size))
            assert spare[small, jaccard_join.OWN] < 0
            least, who = jaccard_join.least_tokens(sets, np.array([sets.size[small]]))
            assert set(least[who == 0].tolist()) & set(least[who == 1].tolist())


def test_jaccard_of_odd_rows(spark, none):
    rows = [(None, "one two three four five six"), (5, "one two three four five six"), (5, "other words of one id here"), (7, None), (8, "")]
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7), (8, 0, 8)], key=str)
    assert jaccard_join.jaccard_components(none).count() == 0


def pattern_words() -> tuple[str, str]:
    """Two different words that polynomials modulo a power of two cannot tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(1024)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_patterns_of_letters_and_words(spark):
    one, two = pattern_words()
    text = lambda w: " ".join([*(f"t{i}" for i in range(17)), w, *(f"t{i}" for i in range(17, 34))])
    spread = lambda w: " ".join(w)
    rows = [(1, one), (2, two), (3, text(one)), (4, text(two)), (5, spread(one)), (6, spread(two))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs).collect()} == brute_components(rows)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, outputs=("n_words", "n_removed", "kept_sha256")).collect()}
    assert got == brute_repeats(rows, 35)
    assert got[3][1] == got[4][1] == 0


def test_jaccard_in_blocks(spark, monkeypatch):
    """A group of many blocks: near copies of one text, chains that only pass through others, and copies."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 500)
    r = random.Random(9)
    base = sentence(r, 60, 9000).split()
    rows = [(i, " ".join(base[:k] + [f"q{i}"] + base[k + 1 :])) for i, k in enumerate([2, 3, 57, 58] * 12)]
    rows += [(100 + i, " ".join(base[i : i + 60 - i] + [f"c{j}" for j in range(2 * i)])) for i in range(24)]
    rows += [(300 + i, " ".join(f"c{j}" for j in range(i, i + 40))) for i in range(0, 30, 3)]
    want = brute_components(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_exact_sets():
    texts = ["a b c d e f", "A b c d e f", "x y", "", "x y", "a b c d e a b c d e"]
    sizes, names = jaccard_join.exact_sets([t.encode() for t in texts])
    parts = np.split(names, np.cumsum(sizes)[:-1])
    assert sizes.tolist() == [len(shingles(t)) for t in texts]
    assert parts[0].tolist() == parts[1].tolist() and parts[2].tolist() == parts[4].tolist() and len(np.intersect1d(parts[0], parts[5])) == 1


def test_hot_keys_are_joined_whole(spark, monkeypatch):
    from attestra.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 5)
    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (3, 1)) for i in range(n)], "key long, i long")
    known = rows.groupBy("key").count().where("key < 3")
    assert common.join_uses(rows, known, ["key"], "count").groupBy("key").count().orderBy("key").collect() == [(1, 50), (2, 3)]


def test_jaccard_links_null_ids(spark):
    text = lambda word, n: " ".join(f"{word}{i}" for i in range(n))
    rows = [(1, text("a", 40)), (None, text("a", 46)), (2, text("a", 54))]  # 36, 42 and 50 shingles: the ends link by the middle only
    rows += [(9, text("b", 40)), (None, text("b", 42)), (None, text("b", 42)), (None, text("c", 40)), (None, text("c", 41))]
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(1, 36, 1), (None, 42, 1), (2, 50, 1), (9, 36, 9), (None, 38, 9), (None, 38, 9), (None, 36, None), (None, 37, None)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("hot", [1000, 3])
def test_components_of_stars(spark, monkeypatch, hot):
    """Nodes of very many edges, with and without the way for hot ones."""
    from attestra.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", hot)
    edges = [(500, i) for i in range(40)] + [(900, i) for i in range(600, 640)] + [(39, 600), (1000, 1001)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(40), 500, *range(600, 640), 900], 0), 1000: 1000, 1001: 1000}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in graph.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def brute_repeats(rows: list[tuple], window: int) -> dict[int, tuple[int, int, str]]:
    words = {i: WORD.findall(t or "") for i, t, *_ in rows}
    seen = collections.Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if seen[tuple(w[p : p + window])] > 1:
                gone.update(range(p, p + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [35, 12])
def test_repeats(docs, mixed_rows, window):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, window=window, outputs=("n_words", "n_removed", "kept_sha256")).collect()}
    assert got == brute_repeats(mixed_rows, window)


def test_repeats_of_odd_rows(spark, none):
    long = " ".join(f"a{i}" for i in range(50))
    rows = [(1, long), (1, long), (2, None), (3, "few words"), (None, long + " tail"), (4, long.replace("a", "b")), (4, "same id")]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = [(1, 50, 50, ""), (1, 50, 50, ""), (2, 0, 0, ""), (3, 2, 0, "few words"), (None, 51, 50, "tail"), (4, 50, 0, long.replace("a", "b")), (4, 2, 0, "same id")]
    assert got == sorted(want, key=str)
    assert substring_dedup.remove_repeats(none).count() == 0


def brute_search(rows: list[tuple], k: int) -> dict[int, list[tuple[int, float]]]:
    terms = {i: topk_search.TERMS.findall((t or "").lower()) for i, t, *_ in rows}
    n, average = len(terms), sum(map(len, terms.values())) / len(terms)
    df = collections.Counter(t for w in terms.values() for t in set(w))
    counts = {i: collections.Counter(w) for i, w in terms.items()}
    out = {}
    for q in terms:
        if q % 20 == 0:
            scored = []
            for i, c in counts.items():
                hit = [t for t in set(terms[q]) if t in c]
                if hit:
                    s = math.fsum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(terms[i]) / average)) for t in hit)
                    scored.append((-round(s, 6), i))
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_search(docs, mixed_rows, monkeypatch):
    want = brute_search(mixed_rows, 10)
    for block_bytes in (32_000_000, 20_000):  # one block of queries, and several
        monkeypatch.setattr(topk_search, "BLOCK_BYTES", block_bytes)
        got = collections.defaultdict(list)
        for r in topk_search.search(docs, docs.where("doc_id % 20 = 0")).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.doc_id, r.score))
        for q, best in want.items():
            assert [s for _, s in got[q]] == pytest.approx([s for _, s in best], abs=2e-6)
            assert [i for i, _ in got[q]] == [i for i, _ in best]


@pytest.mark.parametrize("k", [1, 10])
def test_wand_with_thresholds(k):
    """Shards of many blocks, with and without a threshold, give what plain sums give."""
    r = np.random.default_rng(5)
    n, terms = 9000, 300
    df = np.sort(r.integers(1, 4000, terms))
    doc = np.concatenate([np.sort(r.choice(n, x, replace=False)) for x in df])
    term, count = np.repeat(np.arange(terms), df), r.integers(1, 6, df.sum())
    by = np.argsort(doc, kind="stable")
    lengths, ids = r.integers(50, 400, n), r.permutation(n) * 3
    index = topk_search.Index(ids, lengths, doc[by], term[by], count[by], 200.0, terms)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    impact = count * 2.2 / (count + 1.2 * (0.25 + 0.75 * lengths[doc] / 200.0))
    for size in (1, 3, 40, 250):
        own = np.sort(r.choice(terms, size, replace=False))
        score = np.round(np.bincount(doc, np.isin(term, own) * idf[term] * impact, minlength=n), 6)
        want = np.lexsort((ids, -score))[: min(k, int((score > 0).sum()))]
        for least in (-np.inf, score[want[-1]] * 0.7, score[want[-1]]):
            found, got = index.top(own, idf[own], k, least)
            assert found.tolist() == want.tolist() and got == pytest.approx(score[want], abs=2e-6)
        assert not len(index.top(own, idf[own], k, score[want[0]] + 1)[0])


def test_many_queries_together():
    """Block by block for all queries at once: as each query alone, and blocks below all thresholds are not read."""
    r = np.random.default_rng(6)
    n, terms, k = 5000, 200, 10
    df = np.sort(r.integers(1, 3000, terms))
    doc = np.concatenate([np.sort(r.choice(n, x, replace=False)) for x in df])
    term, count, lengths, ids = np.repeat(np.arange(terms), df), r.integers(1, 6, df.sum()), r.integers(50, 400, n), r.permutation(n)
    by = np.argsort(doc, kind="stable")
    index = topk_search.Index(ids, lengths, doc[by], term[by], count[by], 200.0, terms)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    asked = [np.sort(r.choice(terms, x, replace=False)) for x in r.integers(1, 150, 300)]
    cuts, flat = np.cumsum([0, *map(len, asked)]), np.concatenate(asked)
    want = [index.top(own, idf[own], k) for own in asked]
    for part in (None, 0.8, 1.0):
        floor = np.array([-np.inf if part is None else part * w[1][-1] for w in want])
        q, found, score = index.best(cuts, flat, idf, k, floor)
        for i, (docs, scores) in enumerate(want):
            assert found[q == i].tolist() == docs.tolist() and score[q == i] == pytest.approx(scores, abs=2e-6)
    index.read = 0
    assert not len(index.best(cuts, flat, idf, k, np.full(len(asked), 1e6))[0]) and index.read == 0


def test_blocks_hold_documents_of_one_kind():
    """Documents of two vocabularies stand in blocks of their own: queries in one of them add nothing up in the other's blocks; results are as plain sums."""
    r = np.random.default_rng(7)
    n, terms, k = 3000, 120, 5
    side = r.integers(0, 2, n)  # dealt at random
    words = [np.unique(np.append(r.choice(60, 30) + 60 * s, 60 * s)) for s in side]
    doc, term = np.repeat(np.arange(n), list(map(len, words))), np.concatenate(words)
    count, lengths = r.integers(1, 4, len(doc)), r.integers(50, 60, n)
    place, blocks = topk_search._places(doc, term, count, n)
    assert len(set(place.tolist())) == n and place.max() < blocks * topk_search.BLOCK
    assert all(len(set(side[place // topk_search.BLOCK == b].tolist())) == 1 for b in range(blocks))
    by = np.argsort(place[doc], kind="stable")
    ids, size = np.full(blocks * topk_search.BLOCK, -1), np.ones(blocks * topk_search.BLOCK, np.int64)
    ids[place], size[place] = np.arange(n), lengths
    index = topk_search.Index(ids, size, place[doc][by], term[by], count[by], 55.0, terms)
    asked = [np.sort(r.choice(60, 12, replace=False)) for _ in range(80)]  # all of the first kind
    idf = np.ones(terms)
    opened, together = [], index._together
    index._together = lambda block, *a: opened.append(block) or together(block, *a)
    q, found, score = index.best(np.cumsum([0, *map(len, asked)]), np.concatenate(asked), idf, k, np.full(80, -np.inf))
    assert opened and {int(side[place // topk_search.BLOCK == b][0]) for b in opened} == {0}
    impact = count * 2.2 / (count + 1.2 * (0.25 + 0.75 * lengths[doc] / 55.0))
    for i, own in enumerate(asked):
        want = np.round(np.bincount(doc, np.isin(term, own) * impact, minlength=n), 6)
        best = np.lexsort((np.arange(n), -want))[:k]
        assert ids[found[q == i]].tolist() == best.tolist() and score[q == i] == pytest.approx(want[best], abs=2e-6)


def test_texts_become_terms_once(spark, data):
    """What answers the queries reads stored terms, not the texts."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = topk_search.search(docs, docs.where("doc_id % 20 = 0"))
    assert found.inputFiles() and all("bm25-documents" in f for f in found.inputFiles())


def test_terms_that_share_a_name_are_named_anew(spark, mixed_rows, docs, monkeypatch):
    seeds = spark.sparkContext.accumulator(0)

    class Clash(topk_search.Named):
        def named(self):
            one = super().named()
            seeds.add(self.seed)
            return one % 97 if self.seed == 0 else one

    monkeypatch.setattr(topk_search, "Named", Clash)
    want, got = brute_search(mixed_rows, 10), {}
    for r in topk_search.search(docs, docs.where("doc_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.score)
    assert seeds.value > 0
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items() if x}
    assert all(got[q] == pytest.approx([s for _, s in x], abs=2e-6) for q, x in want.items() if x)


def test_search_of_odd_rows(spark):
    """Query rows of one id have results of their own; null ids are left out; other columns may have any name."""
    docs = spark.createDataFrame([(1, "red green", 0), (2, "green blue", 1), (2, "green blue", 1), (None, "red", 2), (4, None, 3), (5, "", 4)], "doc_id long, text string, score int")
    asked = spark.createDataFrame([(7, "red"), (7, "BLUE blue"), (None, "red"), (8, None), (9, "unknown")], "doc_id long, text string")
    got = [(r.query_id, r["rank"], r.doc_id) for r in topk_search.search(docs, asked).collect()]
    assert sorted(got) == [(7, 1, 1), (7, 1, 2), (7, 2, 2)]


def test_search_of_nothing(none):
    assert topk_search.search(none, none).count() == 0


def test_targets():
    mix = mixing.Mix()
    assert mixing.targets([], mix) == []
    assert mixing.targets([100, 100, 100], mix) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([0, 10], mix) == [0.0, pytest.approx(15.0)]
    sizes = [50, 1000, 10, 0, 700, 33]
    got = mixing.targets(sizes, mix)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(g <= 2 * s + 1e-9 for g, s in zip(got, sizes, strict=True))


def test_split_quotas_are_exact():
    rng = np.random.default_rng(1)
    quotas = np.array([100, 7, 0, 55])
    parts = mixing.split_quotas(quotas, 5, rng)
    assert sum(parts).tolist() == quotas.tolist()
    assert max(p.sum() for p in parts) - min(p.sum() for p in parts) <= 2


def test_mix(spark, docs, mixed_rows, none):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(mixed_rows)
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in mixed_rows}
    source = {i: s for i, _, s, *_ in mixed_rows}
    names = sorted({s for s in source.values() if s}) + [None]
    sums = [sum(size[i] for i in size if source[i] == s) for s in names]
    want = dict(zip(names, mixing.targets(sums, mixing.Mix()), strict=True))
    taken = collections.Counter()
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sums[names.index(source[r.doc_id])]
        assert r.target == pytest.approx(want[source[r.doc_id]])
        assert len(r.draws) <= 2 and len({d["pass"] for d in r.draws}) == len(r.draws)
        taken[source[r.doc_id]] += len(r.draws) * r["size"]
    for s in names:
        assert abs(taken[s] - want[s]) <= max(size[i] for i in size if source[i] == s) / 2 + 1
    again = {r.doc_id: r.draws for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.draws for r in rows}
    assert mixing.mix_sources(none).count() == 0


def test_mix_follows_the_splitting_tree(spark):
    """Each shard's takes of a source are whole blocks, as many as the tree's quota, and no block's pass is in two shards."""
    docs = spark.createDataFrame([(i, "one two three", f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    mix = mixing.Mix(blocks=32, shards=5)
    sums = [{"_source": f"s{r.s}", "_block": r.b, "words": r.w} for r in docs.selectExpr("substring(source, 2) AS s", f"pmod(xxhash64({mix.seed}, doc_id), 32) AS b", "3L AS w").groupBy("s", "b").sum("w").withColumnRenamed("sum(w)", "w").collect()]
    plan, rest = mixing._block_plan([dict(x, _source="s" + x["_source"]) for x in sums], mix)
    quotas = collections.Counter((name, shard) for name, _, _, _, whole, part, _ in plan for _, shard in [*whole, *part])
    drawn = collections.defaultdict(set)
    block = {r.doc_id: r.b for r in docs.selectExpr("doc_id", f"pmod(xxhash64({mix.seed}, doc_id), 32) AS b").collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    for r in mixing.mix_sources(docs, mix=mix).collect():
        for d in r.draws:
            drawn["s" + source[r.doc_id], block[r.doc_id], d["pass"]].add(d["shard"])
    assert all(len(s) == 1 for s in drawn.values())
    found = collections.Counter((name, min(s)) for (name, _, _), s in drawn.items())
    assert found == quotas and len({s for _, s in quotas}) == 5


def test_mix_and_shards_of_odd_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (None, None, "s"), (2, "", "s"), (3, "word " * 300_000, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r["size"] for r in mixing.mix_sources(docs).collect()) == [0, 0, 1, 2, 2, 300_000]
    placed = sharding.shard_by_kd_tree(docs, shards=3).collect()
    assert sorted(r["size"] for r in placed) == [16, 16, 17, 19, 19, 1_500_016]
    slots = collections.defaultdict(list)
    for r in placed:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mix_meets_targets_of_null_and_repeated_ids(spark):
    """Sources of null ids, of one id, and of one row many times: each comes near its target."""
    texts = lambda n: [" ".join(["w"] * (20 + i % 7)) + f" t{i}" for i in range(n)]
    rows = [(None, t, "a") for t in texts(400)] + [(7, t, "b") for t in texts(400)] + [(8, "one two three four", "c")] * 400 + [(i, t, None) for i, t in enumerate(texts(100), 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for keep in ((), ("source", "text")):
        taken, target = collections.Counter(), {}
        for r in mixing.mix_sources(docs, keep=keep).collect():
            s = r.k_source if keep else {400 * 4: "c"}.get(r.source_size) or ("b" if r.doc_id == 7 else "a" if r.doc_id is None else None)
            taken[s] += r["size"] * len(r.draws)
            target[s] = r.target
        assert set(taken) == {"a", "b", "c", None}
        for s, t in target.items():
            assert abs(taken[s] - t) <= 30


ODD = "doc_id long, text string, source string, lang string, _sha string, g_id long, g_key string, `a.b` int, m map<string,int>, kept boolean, node long, draws int"


def test_pipeline_of_clashing_columns_and_no_labels(spark, data):
    """No label to learn from, names that the operators use themselves, a map beside repeated rows, null ids: nothing is lost."""
    pipeline = importlib.import_module("corpus_pipeline")
    more = (None, "sha", 1, "key", 5, {"x": 1}, True, 9, 3)
    text = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [(1, text, "s", *more), (1, text, "s", *more), (None, "another text of some words here", "s", *more), (3, "12 34", "s", *more), (4, None, None, *more), (5, text + " again", None, *more)]
    docs = spark.createDataFrame(rows, ODD)
    spoken = pipeline.language(spark, docs, data)
    assert spoken.dtypes == docs.dtypes
    assert sorted((r.doc_id or 0, r.text) for r in spoken.collect()) == sorted((r[0] or 0, r[1]) for r in rows if r[0] not in (3, 4))
    single = pipeline.exact(spark, docs, data)
    assert single.dtypes == docs.dtypes
    assert sorted(r.doc_id or 0 for r in single.collect()) == [0, 1, 3, 4, 5]
    assert all(r._sha == "sha" and r.g_id == 1 and r.m == {"x": 1} and r["a.b"] == 5 for r in single.collect())
    near = pipeline.near(spark, single, data)
    assert near.dtypes == docs.dtypes
    assert sorted(r.doc_id or 0 for r in near.collect()) == [0, 1, 3, 4]
    mixed = pipeline.mix(spark, near, data)
    assert mixed.dtypes == docs.dtypes
    assert all(r.node == 9 and r.draws == 3 for r in mixed.collect())
    assert pipeline.encode(spark, mixed, data).count() == mixed.count()


def test_pipeline_of_no_rows(spark, data):
    pipeline = importlib.import_module("corpus_pipeline")
    for _, stage in pipeline.STAGES:
        assert stage(spark, spark.createDataFrame([], ODD), data).count() == 0


def test_queries_return_their_columns(spark, data):
    """The registered queries of mixing, sharding and languages on the smallest tables."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in mixing.op8_mix_sources(spark, data).collect():
        assert r.taken == r["size"] * len(r.shards) and len(r.shards) == len(r.shuffle_keys) <= 2
    placed = sharding.op9_kd_tree_shards(spark, data).collect()
    assert {r.doc_id for r in placed} == set(docs) and {r.law for r in placed} == {"bytes"} and {r.grown_shard for r in placed} == {None}
    assert {r.shard for r in placed} == set(range(40))
    from attestra.llm import language_id

    held = {r.doc_id: r.held_out for r in language_id.op3_language_id(spark, data).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in docs}


def test_shards(docs, mixed_rows, none, spark):
    rows = sharding.shard_by_kd_tree(docs, shards=6).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, *_ in mixed_rows)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    shard_of = collections.defaultdict(set)
    text = {i: t for i, t, *_ in mixed_rows}
    for r in rows:
        assert r["size"] == len((text[r.doc_id] or "").encode()) + 16
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        shard_of[text[r.doc_id] or ""].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values())
    assert sharding.shard_by_kd_tree(none).count() == 0


def test_shards_near_equal_with_a_hot_group(spark):
    r = random.Random(5)
    rows = [(i, "same text over and over " * 8 if i % 3 == 0 else sentence(r, r.randint(5, 60), 9999), f"s{i % 4}") for i in range(4000)]
    got = sharding.shard_by_kd_tree(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards=10).groupBy("shard").sum("size").collect()
    sums = [x[1] for x in got]
    assert len(sums) == 10 and max(sums) < 1.06 * min(sums)


def test_pipeline(spark, data):
    """Stage by stage against plain versions on what each stage was given."""
    pipeline = importlib.import_module("corpus_pipeline")
    given = spark.read.parquet(f"{data}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "123 456", "en", "src0", 7), (10**6 + 1, None, None, None, 0)], given.schema)
    now = given.unionByName(extra)
    kept = {}
    for name, stage in pipeline.STAGES:
        before = [(r.doc_id, r.text, r.source) for r in now.collect()]
        after = stage(spark, now, data)
        kept[name] = after.collect()
        if name == "language_id":
            assert {r.doc_id for r in kept[name]} == {i for i, t, _ in before if t and re.search(r"[^\W\d_]", t)}
        elif name == "exact_dedup":
            last = {lower(t): i for i, t, _ in sorted(before, key=lambda x: x[0])}
            assert sorted(r.doc_id for r in kept[name]) == sorted(last.values())
        elif name == "ngram_jaccard_join":
            assert sorted(r.doc_id for r in kept[name]) == sorted({c for _, c in brute_components(before).values()})
        elif name == "mix_sources":
            assert max(collections.Counter(r.doc_id for r in kept[name]).values()) <= 2
            assert {(r.doc_id, r.text) for r in kept[name]} <= {(i, t) for i, t, _ in before}
        else:
            assert len(kept[name]) == len(before) and all(r.n_tokens == len(r.ids) for r in kept[name])
        if name != "bpe_encode":
            assert after.columns == given.columns
            now = spark.createDataFrame(kept[name], given.schema)


def test_pipeline_of_repeated_and_null_ids(spark, data):
    pipeline = importlib.import_module("corpus_pipeline")
    text = lambda word, n: " ".join(f"{word}{i}" for i in range(n))
    schema = "doc_id long, text string, source string"
    rows = [(1, text("a", 40), "s"), (5, text("a", 42), "s"), (5, text("clean", 30), "s"), (None, text("a", 44), "s"), (None, text("b", 40), "s"), (None, text("b", 42), "s"), (7, text("d", 20), "s")]
    rows += [(7, text("d", 20), "s"), (8, text("E", 20), "s"), (8, text("e", 20), "s"), (None, text("f", 20), "s"), (None, text("f", 20), "s"), (9, None, "s")]
    kept = pipeline.exact(spark, spark.createDataFrame(rows, schema), data).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, lower(r.text)) for r in kept) == sorted({(i is None, i or 0, lower(t)) for i, t, _ in rows})
    kept = [tuple(r) for r in pipeline.near(spark, spark.createDataFrame(kept, schema), data).collect()]
    b = [r for r in kept if r[1] and r[1].startswith("b0")]
    assert len(b) == 1
    assert sorted((i or 0, lower(t)) for i, t, _ in kept if (i, t, "s") not in b) == sorted((i or 0, lower(t)) for i, t in [(1, text("a", 40)), (5, text("clean", 30)), (7, text("d", 20)), (8, text("e", 20)), (None, text("f", 20)), (9, None)])


def test_pipeline_writes_shards_in_shuffled_order(spark, data):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.createDataFrame([(i, f"one two three {i}", f"s{i % 3}") for i in range(600)], "doc_id long, text string, source string")
    draws = {}
    for r in mixing.mix_sources(docs).collect():
        for d in r.draws:
            draws.setdefault(d["shard"], []).append((d["shuffle_key"], r.doc_id))
    want = {s: [i for _, i in sorted(part)] for s, part in draws.items()}
    parts = [[r.doc_id for r in part] for part in pipeline.mix(spark, docs, data).rdd.glom().collect()]
    assert sum(map(len, parts)) == sum(map(len, want.values()))
    for part in parts:  # whole shards, one after another
        at = 0
        while at < len(part):
            shard = next(s for s, ids in want.items() if part[at : at + len(ids)] == ids)
            at += len(want.pop(shard))
    assert not want


def test_pipeline_cuts_shards_into_even_files(spark, data):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.createDataFrame([(i, f"one two three {i}", f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    place = {}
    for r in mixing.mix_sources(docs).collect():
        for d in r.draws:
            place.setdefault((d["shard"], d["shuffle_key"]), []).append(r.doc_id)
    want = [i for k in sorted(place) for i in place[k]]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = [[r.doc_id for r in part] for part in pipeline.mix(spark, docs, data).rdd.glom().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [i for part in parts for i in part] == want
    assert len(parts) > 1 and max(map(len, parts)) < 2 * len(want) / len(parts)


def test_jaccard_of_hot_components(spark, monkeypatch):
    """A component with more rows than a hot key's, and the same rows without the way for hot ones."""
    from attestra.llm import common

    text = lambda word, n: " ".join(f"{word}{i}" for i in range(n))
    rows = [(i, text("a", 60)) for i in range(12)] + [(20 + i, text("a", 60 + i % 3)) for i in range(6)] + [(40, text("b", 30)), (41, text("c", 30)), (42, None), (None, text("a", 60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(common, "LEAST_HOT", 3)
    got = {r.doc_id: (r.component_id, r.kept) for r in jaccard_join.jaccard_components(docs, choose=True).collect()}
    assert len(got) == len(rows)
    assert got == {**{i: (0, t == text("a", 60) and i == 0) for i, t in rows}, 40: (40, True), 41: (41, True), 42: (42, True)}


def test_whole_blocks_are_passed_over():
    """The k-th best score is known; the maxima of all blocks but the first stay below it: only the first is opened."""
    size, blocks = topk_search.BLOCK, 200
    n = size * blocks
    doc = np.tile(np.arange(n), 3)
    term = np.repeat(np.arange(3), n)
    count = np.ones(3 * n, np.int64)
    count[:size] = 50  # only the first block's documents have the first term often
    lengths = np.full(n, 100)
    index = topk_search.Index(np.arange(n), lengths, doc, term, count, 100.0, 3)
    weights = np.array([2.0, 1.0, 1.0])
    want = index.top(np.arange(3), weights, 10)
    assert want[0].tolist() == list(range(10))
    index.read = 0
    got = index.top(np.arange(3), weights, 10, float(want[1][-1]))
    assert got[0].tolist() == want[0].tolist()
    assert got[1].tolist() == want[1].tolist()
    assert 0 < index.read <= 3 * size
    index.read = 0
    index.top(np.arange(3), weights, 10)  # without a threshold the first blocks give one
    assert index.read <= 3 * size * topk_search.OPENED


def test_terms_before_the_pivot_are_not_read():
    """A block whose documents can't reach the score without the rare term: the common term's postings are not read."""
    size = topk_search.BLOCK
    doc = np.concatenate([np.arange(size), [7]])
    term = np.concatenate([np.zeros(size, np.int64), [1]])
    index = topk_search.Index(np.arange(size), np.full(size, 10), doc, term, np.ones(size + 1, np.int64), 10.0, 2)
    docs, scores = index.top(np.arange(2), np.array([0.1, 5.0]), 1, 4.0)
    assert docs.tolist() == [7]
    assert scores[0] == pytest.approx(5.1)
    index.read = 0
    assert index.top(np.arange(2), np.array([0.1, 5.0]), 1, 5.2)[0].tolist() == []
    assert index.read == 0


def test_large_groups_meet_by_buckets(spark, monkeypatch):
    """A group that hangs together by chance sends each set about as often as it is in a bucket, not once for each block; sets of a bucket reduced to leaders still meet."""
    monkeypatch.setattr(jaccard_join, "BLOCK_TOKENS", 60)
    n = 120
    texts = {i: " ".join(f"w{i // 2}x{k}" for k in range(12)) for i in range(n)}  # 2k and 2k + 1 are equal
    texts[0] = texts[n - 1] = " ".join(f"far{k}" for k in range(12))  # in different batches of a hot bucket
    sets = spark.createDataFrame([(i, t.encode(), 3.0) for i, t in texts.items()], "node long, text binary, weight double")
    groups = spark.createDataFrame([(i, 0) for i in range(n)], "node long, root long")
    buckets = [(i, 1000 + i, 1) for i in range(n)] + [(i + 1, 1000 + i, 1) for i in range(n - 1)]
    hot = [(0, 5000, jaccard_join.ALWAYS), (1, 5000, jaccard_join.ALWAYS), (1, 5001, jaccard_join.ALWAYS), (n - 2, 5001, jaccard_join.ALWAYS), (n - 2, 5002, jaccard_join.ALWAYS), (n - 1, 5002, jaccard_join.ALWAYS)]
    sent, cells = [], jaccard_join._cells
    monkeypatch.setattr(jaccard_join, "_cells", lambda rows: (sent.append(rows.count()), cells(rows))[1])
    links = jaccard_join._links(sets, groups, spark.createDataFrame(buckets + hot, "node long, hub long, cost int"))
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in links.collect() if r.a != r.b}
    assert found == {(2 * k, 2 * k + 1) for k in range(1, n // 2 - 1)} | {(0, n - 1)}
    assert sum(sent) <= 8 * n  # the whole group: 6 blocks, each set 12 times and more
