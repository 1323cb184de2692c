"""Collocations, near-duplicate embeddings and spelling variants against brute force."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from attestra.llm import collocations, embedding_dedup, spelling
from attestra.llm.common import LOWER, UPPER

LOWERED = str.maketrans(UPPER, LOWER)


# Collocations


def plain_collocations(rows, least, max_words, top, share=50):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWERED)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, max_words + 1):
                for i in range(len(ws) - k + 1):
                    counts[lang][tuple(ws[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        found = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        inside = collections.Counter()
        for p, v in found.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if 1 < j - i < len(p):
                    inside[p[i:j]] = max(inside[p[i:j]], v)
        rows = []
        for p, a in found.items():
            if 100 * inside[p] >= share * a:
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))  # noqa: E741
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):  # noqa: E741
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


@pytest.fixture(scope="module")
def phrases():
    r = random.Random(3)
    words = [f"w{i}" for i in range(12)] + ["É", "é", "日本", "New", "york", "x" * 40]
    rows = []
    for _ in range(300):
        ws = [words[min(int(r.expovariate(0.25)), len(words) - 1)] for _ in range(r.randrange(60))]
        text = "".join(w + r.choice([" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!", " : ", "\xa0"]) for w in ws)
        rows.append((text, r.choice(["en", "en", "fr", None, "und", ""])))
    rows += [(None, "en"), ("", "fr"), (" .,; ", "en"), ("aa aa aa aa aa aa aa aa aa aa aa aa", "en"), (". ".join(["New York City"] * 12), "en")] + [("same same line again", "de")] * 11
    return rows


@pytest.mark.parametrize(("least", "max_words", "top"), [(10, 3, 2000), (3, 4, 7), (2, 2, None)])
def test_collocations(spark, phrases, least, max_words, top):
    docs = spark.createDataFrame([(t, g, 1, "k") for t, g in phrases], "text string, lang string, n int, phrase string").repartition(5)
    got = collocations.collocations(docs, least=least, max_words=max_words, top=top).collect()
    assert sorted(map(tuple, got)) == plain_collocations(phrases, least, max_words, top)


def test_collocations_of_products_beyond_64_bits(spark):
    level = spark.createDataFrame([("de", "a b", 10**12, None, [10**12 + 7], [3 * 10**12])], "lang string, phrase string, a long, inside long, lefts array<long>, rights array<long>")
    score = level.select(collocations.best_cut().alias("c")).first().c.score
    assert score == 10**6 * 10**24 // ((10**12 + 7) * 3 * 10**12)


def test_collocations_of_no_rows(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []


def test_phrases_have_their_halves_as_parents(spark, phrases):
    docs = spark.createDataFrame(phrases, "text string, lang string")
    rows = {r.id: r for r in collocations.frequent_phrases(docs, least=5)[0].collect()}
    assert len({r.k for r in rows.values()}) == 3
    for r in rows.values():
        if r.k > 1:
            words = r.phrase.split(" ")
            assert rows[r.left].phrase == " ".join(words[:-1])
            assert rows[r.right].phrase == " ".join(words[1:])
            assert rows[r.left].lang == rows[r.right].lang == r.lang
            assert r.lefts[-1] == rows[r.left].a
            assert r.rights[0] == rows[r.right].a


# Embeddings


def plain_links(rows, threshold=0.95):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = collections.defaultdict(set)
    for i, j in itertools.combinations(good, 2):
        a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
        if len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
            near[i].add(j)
            near[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def near_vector(r, v, cosine):
    """A vector at a cosine from a unit vector."""
    other = r.standard_normal(len(v))
    other -= (other @ v) * v
    return cosine * v + math.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def test_embeddings_of_odd_rows(spark):
    r = np.random.default_rng(1)
    unit = lambda n: (lambda v: v / np.linalg.norm(v))(r.standard_normal(n))
    base = [unit(16) for _ in range(20)]
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, near_vector(r, base[i % 20], 0.96 + 0.03 * r.random()).tolist()) for i in range(40)]
    rows += [(200, base[0].tolist()), (200, base[0].tolist()), (201, (base[0] * 7).tolist()), (None, base[1].tolist()), (None, near_vector(r, base[2], 0.99).tolist())]
    lone = unit(16)
    rows += [(None, lone.tolist()), (None, (2 * lone).tolist()), (300, None), (300, None), (301, []), (302, [0.0] * 16), (303, [1.0, None]), (304, [float("nan")] * 16), (305, [float("inf")] + [0.0] * 15), (None, None)]
    rows += [(400, [1.0, 0.0]), (401, [1.0, 0.0, 0.0]), (402, [2.0, 0.1]), (403, [-0.0, 1.0]), (404, [0.0, 1.0]), (405, [3.0]), (406, [1e-30]), (407, [-1.0])]
    vectors = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, node string, copies int").repartition(4)
    got = sorted((tuple(x) for x in embedding_dedup.near_duplicates(vectors).collect()), key=repr)
    assert got == plain_links(rows)
    sql = duckdb.connect()
    sql.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    sql.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(sql.execute(embedding_dedup.ORACLE).fetchall(), key=repr) == got


def test_embeddings_at_the_threshold_are_found(spark):
    """Recall against brute force, of pairs just above the threshold: 0.99 at least; nothing below it links."""
    r = np.random.default_rng(2)
    base = [v / np.linalg.norm(v) for v in r.standard_normal((1500, 48))]
    rows = [(2 * i, v.tolist()) for i, v in enumerate(base)] + [(2 * i + 1, near_vector(r, v, 0.9502 if i % 2 else 0.9498).tolist()) for i, v in enumerate(base)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {x.vec_id: x for x in embedding_dedup.near_duplicates(vectors).collect()}
    assert sum(got[2 * i].n_links for i in range(1500) if i % 2) >= 0.99 * 750
    assert sum(got[2 * i].n_links for i in range(0, 1500, 2)) == 0


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """A bucket of many blocks; every link is counted once."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 64)
    r = np.random.default_rng(3)
    v = r.standard_normal(32)
    v /= np.linalg.norm(v)
    rows = [(i, near_vector(r, v, 0.96 + 0.035 * (i % 2)).tolist()) for i in range(400)] + [(1000 + i, x.tolist()) for i, x in enumerate(r.standard_normal((200, 32)))] + [(5000 + i, v.tolist()) for i in range(50)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((tuple(x) for x in embedding_dedup.near_duplicates(vectors, recall=0.9999).collect()), key=repr)
    assert got == plain_links(rows)


def test_estimates_have_no_bias():
    """The estimate's mean over rotations is the inner product, and the bound holds."""
    r = np.random.default_rng(5)
    x = r.standard_normal(24)
    x /= np.linalg.norm(x)
    for cosine in (0.3, 0.8, 0.95):
        y = near_vector(r, x, cosine)
        found = []
        for seed in range(400):
            one, two = embedding_dedup.rotations(24, 64, 2 * seed)
            a, b = np.sign(one @ x), np.sign(two @ y)
            found.append(((a @ one) @ (b @ two)) / ((np.abs(one @ x).sum()) * (np.abs(two @ y).sum())))
        assert abs(np.mean(found) - cosine) < 4 * np.std(found) / 20


def test_embeddings_of_no_rows(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    got = embedding_dedup.near_duplicates(spark.createDataFrame([(3, None), (4, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted(map(tuple, got)) == [(3, 0, 3, True), (4, 0, 4, True)]


# Spelling variants


def plain_variants(rows, change=199, least=5):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWERED)
            h = zlib.crc32(f"{key}:{run}".encode())
            if change and h % change == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= least}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    found = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in found.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(found[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def spelt():
    r = random.Random(4)
    words = set()
    for _ in range(60):
        word = "".join(r.choice("abÀéÿ×") for _ in range(r.choice([5, 6, 6, 7, 8, 12])))
        for _ in range(r.randrange(6)):
            words.add(word)
            at, kind = r.randrange(len(word)), r.randrange(3)
            word = word[:at] + (r.choice("abé") if kind else "") + word[at + (kind != 1) :]
    words = sorted(words) + ["a" * 300, "a" * 301, "aaaaaa", "aaaaaaa", "aaaaab", "baaaaa", "abaaaa"]
    rows = []
    for i in range(120):
        chosen = [words[min(int(r.expovariate(1 / 40)), len(words) - 1)] for _ in range(60)]
        text = "".join((w.upper() if r.random() < 0.1 and w.isascii() else w) + r.choice([" ", "-", "1", "日", ". ", "Ā"]) for w in chosen)
        rows.append((i if i % 9 else None, text))
    rows += [(7, " ".join(["gggggg"] * 5 + ["ggggggg"] * 30 + ["gggggggg"] * 200 + ["qggggg"] * 6))]
    return [*rows, (1, None), (2, ""), (3, "123 ... 日本"), (4, rows[0][1]), (4, rows[0][1])]


@pytest.mark.parametrize(("change", "shard_words"), [(199, 1_000_000), (3, 40), (0, 7)])
def test_spelling_variants(spark, spelt, change, shard_words):
    docs = spark.createDataFrame([(i, t, "x", 2) for i, t in spelt], "doc_id long, text string, word string, n int").repartition(4)
    got = spelling.spelling_variants(docs, change=change, shard_words=shard_words).select("word", "n", "n_near", "form", "form_n", "root").collect()
    want = plain_variants(spelt, change)
    assert sorted(map(tuple, got), key=repr) == want
    assert any(w[3] and w[5] != w[3] for w in want) or change == 3  # forms of forms


def test_spelling_variants_of_no_rows(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_trie_holds_its_words():
    words = sorted(["aaaaaa", "aaaaab", "zz", "é", "éa", "ÿ" * 20])
    trie = spelling.Trie(words)
    for number, word in enumerate(words):
        node = np.zeros(1, np.int64)
        for letter in word.encode("latin-1"):
            node = trie.next(node, np.array([letter]))
        assert trie.word[node[0]] == number
    assert trie.next(np.zeros(1, np.int64), np.array([98]))[0] == -1
