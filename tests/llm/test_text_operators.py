"""Token counts, BPE, language identification and page content against the libraries and plain versions."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from attestra.llm import bpe, html_content, html_pages, language_id, token_counts

PATH = bpe.default_path()
ODD = [
    None, "", " ", "\n\t ", "<|endoftext|>", "a<|endoftext|>B <|startoftext|> c", "İstanbul ΣΑΣ ß ﬁ é 日本語 1²3 don't I'LL \x1c\x1d a\x85b　c", "a" * 3000, "ab" * 700 + " zz",
    "\0<|endoftext|>", "x\n\n  y\t z", "👩‍👩‍👧 ok 🇫🇷", "ё́ é́ ͅ", "the the the", "ﷺ ①½", "A<|END",
]


@pytest.fixture(scope="module")
def library() -> Tokenizer:
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "extra", 1) for i, t in enumerate(ODD)] + [(3, "again", "x", 2), (None, "no id", "x", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")


def test_familiar_characters_split_alike():
    own = bpe.merger(PATH)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not own.unfamiliar.search(chr(c))]
    assert len(points) > 20_000
    for c in [p for p in points if p < 0x3000] + random.Random(1).sample(points, 2000):
        text = f"A{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} x"
        assert own._quick_pieces(text) == own._library_pieces(text), hex(c)


def test_encode_as_the_library(odd, library):
    got = bpe.encode_documents(odd, PATH, outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(ODD) + 2
    texts = {i: t for i, t in enumerate(ODD)} | {None: "no id"}
    for r in got:
        for text in [texts[r.doc_id], "again"] if r.doc_id == 3 else [texts[r.doc_id]]:
            ids = library.encode(text or "", add_special_tokens=False).ids
            if r["ids"] == ids:
                break
        assert r["ids"] == ids and r.n_tokens == len(ids)
        decoded = library.decode(ids, skip_special_tokens=False)
        assert r.decoded == decoded
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_token_counts_as_the_library(odd, library):
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd, PATH).collect())
    want = [(i, t) for i, t in enumerate(ODD)] + [(3, "again"), (None, "no id")]
    assert got == sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in want)


def test_whole_tokens_are_proved(library):
    whole = token_counts.whole_tokens(PATH)
    for word in random.Random(2).sample(sorted(whole), 300):
        word_ids = library.model.tokenize("".join(bpe.byte_letters()[b] for b in word.encode()))
        assert len(word_ids) == 1


def test_byte_level_file_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["Hello  world!\n\n x", "naïve café 日本", "", None, "it's   spaced "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode_documents(docs, path)
    for r in encoded.collect():
        assert r["ids"] == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
    back = {r.doc_id: r.text for r in bpe.decode_ids(encoded, path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_sentence_model_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["Hello world", "two  spaces", " lead", "naïve café", "", None, "a b c d", "word\nline", "x" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, path).collect()} == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


def test_long_piece_takes_the_same_merges(library):
    own = bpe.merger(PATH)
    for piece in ("ab" * 400, "".join(random.Random(3).choices("abcdeth", k=900)), "é" * 400):
        assert own.encode_pieces([piece])[0].tolist() == library.encode(piece, add_special_tokens=False).ids


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert bpe.encode_documents(empty, PATH).count() == 0
    assert token_counts.count_tokens(empty, PATH).count() == 0
    assert language_id.learn_profiles(empty) == {}
    assert language_id.identify(empty, {}).count() == 0
    assert html_content.extract_content(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def plain_profile(texts: list[str]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for t in texts:
        for w in language_id.WORDS.findall(t.lower()):
            for g in language_id.grams_of(w):
                counts[g] = counts.get(g, 0) + 1
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], g))[: language_id.PROFILE])}


def test_language_profiles_and_predictions(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    train = docs.where(language_id.fold() != 0)
    profiles = language_id.learn_profiles(train)  # fewer rows than the sample: all of them
    rows = docs.toPandas()
    train_rows = train.toPandas()
    for lang, part in train_rows.groupby("lang"):
        assert profiles[lang] == plain_profile(list(part.text))
    got = {r.doc_id: r for r in language_id.identify(docs, profiles).collect()}
    for _, r in rows.head(40).iterrows():
        counts: dict[str, int] = {}
        for w in language_id.WORDS.findall(r.text.lower()):
            for g in language_id.grams_of(w):
                counts[g] = counts.get(g, 0) + 1  # those in no profile too: they keep their ranks
        order = sorted(counts, key=lambda g: (-counts[g], g))[: language_id.PROFILE]
        away = {lang: sum(abs(i - p[g]) if g in p else language_id.PROFILE for i, g in enumerate(order)) for lang, p in profiles.items()}
        best = min(away, key=lambda lang: (away[lang], lang))
        assert got[r.doc_id].lang_pred == best
        assert got[r.doc_id].score == pytest.approx(1 - away[best] / (language_id.PROFILE * len(order)))
    held = docs.where(language_id.fold() == 0).toPandas()
    assert np.mean([got[i].lang_pred == lang for i, lang in zip(held.doc_id, held.lang, strict=True)]) > 0.97


def test_language_of_odd_texts(spark):
    profiles = {"en": {"e": 0, "t": 1, "th": 2}, "de": {"d": 0, "ch": 1}}
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "123 !!", "c"), (4, "the thin", "d"), (4, "ich dich", "e"), (None, "éé", "f"), (6, "日本", "g")], "doc_id long, text string, score string")
    got = {(r.doc_id, r.k_score): (r.lang_pred, r.score) for r in language_id.identify(docs, profiles, keep=("score",)).collect()}
    assert [got[(i, c)] for i, c in ((1, "a"), (2, "b"), (3, "c"))] == [("und", 0.0)] * 3
    assert got[(4, "d")][0] == "en" and got[(4, "e")][0] == "de"
    assert got[(None, "f")] == ("de", 0.0) and got[(6, "g")] == ("de", 0.0)


def test_unknown_ngrams_keep_their_ranks(spark):
    profiles = {"en": {g: i for i, g in enumerate(["e", "th", "t", "he", "_t", "the"])}, "de": {g: i for i, g in enumerate(["e", "ch", "d", "_d", "die"])}}
    han = "".join(chr(c) for c in range(0x4E00, 0x9FF0))  # more letters than 16 bits can name, with the next two
    texts = ["Привет мир, как дела the", "the thin", "日本語 the A_b __c", "a b c", "İstanbul ΣΑΣ ß ﬁ", "e" * 3000, f"{han} the {''.join(chr(c) for c in range(0x20000, 0x2A6D0))} {''.join(chr(c) for c in range(0xAC00, 0xD7A3))}"]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), profiles).collect()}
    for i, text in enumerate(texts):
        order = plain_profile([text])  # every n-gram of the text, in a profile or not
        away = {lang: sum(abs(r - p[g]) if g in p else language_id.PROFILE for g, r in order.items()) for lang, p in profiles.items()}
        best = min(away, key=lambda lang: (away[lang], lang))
        assert got[i].lang_pred == best
        assert got[i].score == pytest.approx(1 - away[best] / (language_id.PROFILE * len(order)))


def test_pages_not_seen_in_training():
    model = html_content.trained()
    pages = html_pages.labelled_pages(200, 4711)
    parsed = [html_content.Page(h) for h in pages]
    want = [p.text(np.array(p.label) > 0) for p in parsed]
    right = np.mean([a == b for a, b in zip(html_content.extract_texts(pages, model), want, strict=True)])
    assert right > 0.85


def paragraphs(n: int = 6) -> list[str]:
    words, r = "the quick brown fox jumps over a lazy dog while seven wizards boil odd jars".split(), random.Random(1)
    return [" ".join(r.choice(words) for _ in range(60)).capitalize() + "." for _ in range(n)]


LAYOUTS = {
    "a plain body": lambda ps: "".join(f"<p>{p}</p>" for p in ps),
    "div blocks in an article": lambda ps: "<article>" + "".join(f"<div>{p}</div>" for p in ps) + "</article>",
    "div blocks in the body": lambda ps: "".join(f"<div>{p}</div>" for p in ps),
    "a column of a table": lambda ps: "<table><tr><td><a href=/>Home</a><br><a href=/n>News</a></td><td>" + "".join(f"<p>{p}</p>" for p in ps) + "</td></tr></table>",
    "unnamed wrappers": lambda ps: "<div><div><div>" + "".join(f"<p>{p}</p>" for p in ps) + "</div></div></div>",
}


@pytest.mark.parametrize("layout", sorted(LAYOUTS))
def test_articles_of_all_layouts(layout):
    ps = paragraphs()
    html = f"<html><head><title>t</title></head><body>{LAYOUTS[layout](ps)}</body></html>"
    assert html_content.extract_texts([html], html_content.trained()) == ["\n".join(ps)]


def test_text_of_the_body_itself():
    ps = paragraphs()
    assert html_content.extract_texts([f"<body>{ps[0]}</body>", "<body>" + "<br><br>".join(ps) + "</body>"], html_content.trained()) == [ps[0], " ".join(ps)]


def test_inline_drawings_and_references():
    ps = paragraphs(3)
    html = f"<article><p>{ps[0]} <svg><text>x</text></svg><math><mi>y</mi></math> end &amp; &<b>amp;</b> more.</p><p>{ps[1]}</p><p>{ps[2]}</p></article>"
    assert html_content.extract_texts([html], html_content.trained())[0].split("\n")[0] == f"{ps[0]} x y end & &amp; more."


def test_deep_pages_take_linear_time():
    began = time.time()
    html_content.extract_texts(["<div>" * 16_000 + "deep"], html_content.trained())
    html_content.Page("<i><p>" * 16_000 + "</b>" * 16_000)
    assert time.time() - began < 20


def test_long_texts_are_cut_nowhere(spark):
    """A text of over a batch's bytes, alone and among short ones, in all text operators."""
    long = "word " * 700_000
    docs = spark.createDataFrame([(1, "a b"), (2, long), (3, None), (4, long)], "doc_id long, text string").repartition(1)
    counted = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, bpe.default_path()).collect()}
    assert counted[2] == counted[4] == (3_500_000, 700_000) and counted[3] == (0, 0)
    named = {r.doc_id: r.lang_pred for r in language_id.identify(docs, {"en": {"w": 0}, "xx": {"q": 0}}).collect()}
    assert named == {1: "en", 2: "en", 3: "und", 4: "en"}


def test_marginals_are_exact():
    """Against the sum over all labellings of small trees."""
    rng = np.random.default_rng(5)
    page = html_content.Page("<body><article><p>some words here.</p><div class=ad>x</div></article><footer>end</footer></body>")
    forest = html_content.Forest([page])
    weights, edge = rng.normal(size=html_content.FEATURES), rng.normal(size=(html_content.EDGE_KINDS, 2, 2))
    p, pair, norm = forest.marginals(weights, edge)
    n, total, sums = len(forest.parent), 0.0, np.zeros(len(forest.parent))
    score = forest.features @ weights
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        s = sum(score[i] * y[i] for i in range(n)) + sum(edge[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(n) if forest.parent[i] >= 0)
        total += np.exp(s)
        sums += np.exp(s) * np.array(y)
    assert np.allclose(sums / total, p) and np.isclose(np.log(total), norm)


def test_content_of_pages(spark):
    article = "<article><h1>A  title\n here</h1><p>First &amp; second&nbsp;part<br>goes on. <a href=x>A link</a> too.<p>Unclosed one with <b>bold</b> words, many of them.</article>"
    html = f"<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script><style>p{{}}</style></head><body><nav><ul><li><a href=a>Home</a></li><li><a href=b>More</a></li></ul></nav><!-- <p>no</p> -->{article}<div class='comments'><p>A comment by a reader.</p></div><footer>&copy; me</footer></body></html>"
    pages = spark.createDataFrame([(1, "u", html, 5), (2, None, None, 6), (3, "u", "", 7), (4, "u", "plain < text & <", 8), (1, "again", html, 9)], "page_id long, url string, html string, text long")
    got = {(r.page_id, r.url): r for r in html_content.extract_content(pages).collect()}
    want = "A title here\nFirst & second part goes on. A link too.\nUnclosed one with bold words, many of them."
    assert got[(1, "u")].text == want and got[(1, "again")].text == want
    assert got[(1, "u")].n_chars == len(want)
    assert got[(2, None)].text == "" and got[(3, "u")].text == "" and got[(2, None)].n_chars == 0


def page_text(html: str) -> str:
    page = html_content.Page(html)
    return page.text(np.ones(len(page.tag)))


def test_attributes_by_position():
    for n in (10, 60_000, 66_000, 1_000_000):
        assert page_text(f"<div data-props='<p>secret json</p>{'y' * n}'>real text</div>") == "real text"
    assert page_text("<a title=Bob's>first words</a><p>It is a long way.</p><p>He said it's far.</p><p>End</p>") == "first words\nIt is a long way.\nHe said it's far.\nEnd"
    assert page_text("<p 'x>one</p><p title='x>two</p>") == "one\ntwo"
    assert page_text("<p a = \"b>c\"d='e>f' / g=h'>one</p><script src=/js/>x</script><p class=x>two") == "one\ntwo"
    page = html_content.Page("<div data-id='x' data-props=\"class='ad'\" CLASS = story id=k class=ad>text</div>")
    assert page.names == ["", " story k"]


def test_tags_take_linear_time():
    start = time.process_time()
    for part in ("<a x='>'", "<a x=\"'", "<a =\"><", "<a x=' <", "<a ", "<a x='"):
        html_content.Page(part * 50_000 + "'")
    assert time.process_time() - start < 20


def test_only_raw_elements_go():
    assert page_text("<p>The sum <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, <svg><title>t</title><path d='M0'/><path><text>a drawing</text></svg> as <object data=x>told</object> here.</p><p>End</p>") == "The sum x = 2 holds, a drawing as told here.\nEnd"
    assert page_text("<p>one<noscript> two</noscript> three<template> four</template></p><select><option>A<option>B</select><xmp>a <b>c</b> &amp; d</xmp>e") == "one two three four\nA\nB\na <b>c</b> &amp; d\ne"
    assert page_text("<p>a<svg/>b<math/>c</p><a href=x><svg><path/></svg>link</a> <math><mtext>if <b>so</b></mtext></math><svg><path><p>out</p>") == "abc\nlink if so\nout"
    assert page_text("<title>t</title><p>one</p><script>var a = 1 <p>two</p><textarea>x<p>three</p><svg><text>four<p>five") == "one\ntwo\nthree\nfour\nfive"
    article = "<article><h1>A title</h1><p>First of the words, many of them, with <math><mi>x</mi></math> among them.</p><p>More of the words, many of them.</p></article>"
    assert html_content.extract_texts([article], html_content.trained()) == ["A title\nFirst of the words, many of them, with x among them.\nMore of the words, many of them."]


def test_content_of_given_pages(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    got = html_content.extract_content(pages).toPandas().set_index("page_id")
    for r in pages.collect():
        inside = r.html.split("<article>")[1].split("</article>")[0]
        first = pd.Series(inside.split("</h1>")[0].replace("<h1>", "")).map(html_content.entities.unescape)[0]
        assert got.text[r.page_id].startswith(" ".join(first.split()))
        assert "var t=" not in got.text[r.page_id]
