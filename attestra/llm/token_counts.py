"""Token counts with a whole-token shortcut.

Which vocabulary strings encode alone as one token is proved once, on the driver, by
merging every one of them: those of which a single token is left are whole tokens. The
proved set, no larger than the vocabulary, goes to the workers. There a text is cut into
pieces; a piece in the set counts 1 directly, and only the rest is merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.bpe import PieceCache, default_path, located, merger, text_batches
from attestra.llm.common import bounded, table


@lru_cache(maxsize=4)
def whole_tokens(path: str) -> frozenset[str]:
    """Pieces that a byte-level BPE file encodes as one token, each proved by merging it."""
    own = merger(path)
    pieces = []
    for token in own.vocab:
        if token.endswith(own.suffix) and len(token) > len(own.suffix):
            try:
                pieces.append(bytes(own.byte_of[c] for c in token[: len(token) - len(own.suffix)]).decode("utf-8"))
            except UnicodeDecodeError:  # part of a character: never a piece
                continue
    return frozenset(p for p, ids in zip(pieces, own.encode_pieces(pieces), strict=True) if len(ids) == 1)


@lru_cache(maxsize=4)
def whole_sentence_pieces(path: str) -> frozenset[str]:
    """The same for a sentencepiece model: strings that begin with the space mark and encode alone as one token."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=located(path))
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    words = [n[1:] for n in names if n.startswith("▁") and len(n) > 1 and "▁" not in n[1:]]
    return frozenset(w for w, ids in zip(words, model.encode(words), strict=True) if len(ids) == 1)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens`` of the whole text, without begin and end tokens.

    Null text counts as empty: 0 bytes, 0 tokens. Strings of special tokens in a text count
    as the library has them. Null or repeated ids pass through. Other columns are not read.
    ``path`` is a byte-level BPE ``.json`` or a sentencepiece ``.model``.
    """
    sentence = path.endswith(".model")
    whole = docs.sparkSession.sparkContext.broadcast(whole_sentence_pieces(path) if sentence else whole_tokens(path))  # within the vocabulary's size
    counts = _sentence_counts if sentence else _bpe_counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counts(path, whole.value)
        for batch in batches:
            n = [c for texts in text_batches(batch.column(2).to_pylist()) for c in of(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(bounded(count, 2), "doc_id long, n_bytes long, n_tokens long")


def _bpe_counts(path: str, whole: frozenset[str]):
    own = merger(path)
    cache = PieceCache(lambda pieces: [len(ids) for ids in own.encode_pieces(pieces)], dict.fromkeys(whole, 1))

    def of(texts: list[str]) -> list[int]:
        split = [own.pieces(t) for t in texts]
        known = cache.of(split)
        return [sum(map(known.__getitem__, pieces)) for pieces in split]

    return of


def _sentence_counts(path: str, whole: frozenset[str]):
    """Words between single spaces stand alone in a model none of whose pieces spans a space mark; other texts go to the library whole."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=located(path))
    apart = all("▁" not in model.id_to_piece(i)[1:] for i in range(model.get_piece_size()))
    cache = PieceCache(lambda words: [len(ids) for ids in model.encode(words)], dict.fromkeys(whole, 1))

    def of(texts: list[str]) -> list[int]:
        plain = [t for t in texts if apart and t.isascii() and t.isprintable() and "  " not in t and t.strip() == t]
        split = [t.split(" ") for t in plain if t]
        known, words = cache.of(split), {id(t): w for t, w in zip([t for t in plain if t], split, strict=True)}
        return [sum(map(known.__getitem__, words[id(t)])) if id(t) in words else len(model.encode(t)) for t in texts]

    return of


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_path()).withColumn("over_limit", F.col("n_tokens") > 2048)
