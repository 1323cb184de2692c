"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

A piece (pre-token) is a row of symbols. The leaves of its segment tree hold the key
``rank * width + position`` of each adjacent pair, or ``NONE``; every node holds the least
key below it. The root so names the leftmost pair of the lowest rank. A merge changes
three leaves (the pair itself, the one before, the one that vanishes), each a point
update of logarithmic cost, until the root is ``NONE``.

Short pieces of a batch are merged side by side, one numpy row each; a long piece gets a
tree of its own in lists, so that one run of 100,000 letters costs n log n.

Pieces repeat, so each Python worker keeps the last ones it met, up to ``CACHE`` entries;
that bounds memory and does not change results.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import bounded, table

NONE = np.iinfo(np.int64).max
CACHE = 100_000
BATCH_CHARS = 1_000_000
LONG = 256
#: The white space of the pattern library that tokenizer files are written for.
SPACE = r"\t-\r \x85\xa0  -     　"
#: Ranges in which Python and the library agree on case, classes and composition (a test runs
#: over them); texts with other characters take the library's own normaliser and splitter.
FAMILIAR = r"\x00-ʯΑ-Ωα-ωЀ-ҁҊ-ԯ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-鿯"


def located(path: str) -> str:
    """A tokenizer's file on this machine: the path itself, else the package's file of that name."""
    if os.path.exists(path):
        return path
    import public_tokenizers

    return public_tokenizers.path(os.path.basename(path))


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in set(shown) else next(spare)) for b in range(256)]


class Merger:
    """Vocabulary and merges of a byte-level BPE file, its splitter and its segment trees."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        path = located(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix"):
            raise ValueError("only byte-level BPE without unknown token, dropout and prefixes")
        self.library = Tokenizer.from_file(path)  # for texts with unfamiliar characters
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.byte_of = {c: b for b, c in enumerate(self.letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens") or []):
            raise ValueError("only plain added tokens")
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.token_of = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.decoder = spec.get("decoder")
        size = max(self.token_of) + 1
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([self.vocab[p[k]] for p in pairs], dtype=np.int64) for k in (0, 1))
        keys = left * size + right
        order = np.argsort(keys, kind="stable")
        self.size, self.keys, self.rank_at = size, keys[order], order.astype(np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.first = np.array([self.vocab[c] for c in self.letters], dtype=np.int64)
        self.last = np.array([self.vocab[c + self.suffix] for c in self.letters], dtype=np.int64)
        self.unfamiliar = regex.compile(f"[^{FAMILIAR}]")
        self._splitter(spec)

    def _splitter(self, spec: dict) -> None:
        """Quick forms of the two known splitters; anything else is left to the library."""
        pre = spec["pre_tokenizer"]
        steps = pre["pretokenizers"] if pre and pre["type"] == "Sequence" else [pre]
        norm = spec["normalizer"]
        names = [n["type"] for n in norm["normalizers"]] if norm and norm["type"] == "Sequence" else [norm["type"]] if norm else []
        self.lower, self.quick = False, None
        if len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and names == ["NFC", "Replace", "Lowercase"]:
            self.lower = True
            self.quick = regex.compile(steps[0]["pattern"]["Regex"].replace("[^\\s", f"[^{SPACE}"))

    def _quick_pieces(self, text: str) -> list[str]:
        # The library lower-cases each letter alone; Python has a rule for a sigma that ends a word.
        text = unicodedata.normalize("NFC", text)
        return self.quick.findall((text.replace("Σ", "σ") if "Σ" in text else text).lower())

    def _library_pieces(self, text: str) -> list[str]:
        text = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [bytes(self.byte_of[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def plain_pieces(self, text: str) -> list[str]:
        return self._quick_pieces(text) if self.quick and not self.unfamiliar.search(text) else self._library_pieces(text)

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text in order; the string of a special token stands for itself as ``\\0`` and the string."""
        if not self.special_at or "<" not in text and all(s[0] == "<" for s in self.special):
            return self.plain_pieces(text)
        out: list[str] = []
        for k, part in enumerate(self.special_at.split(text)):
            if k % 2:
                out.append("\0" + part)
            elif part:
                out += self.plain_pieces(part)
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where it does not merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_at[at], -1)

    def encode_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Token ids of each piece."""
        out: list[np.ndarray | None] = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        raw: list[bytes] = []
        for i, p in enumerate(pieces):
            b = p.encode("utf-8", "surrogateescape")
            raw.append(b)
            if p[:1] == "\0" and p[1:] in self.special:
                out[i] = np.array([self.special[p[1:]]], dtype=np.int64)
            elif len(b) == 1:
                out[i] = self.last[[b[0]]]
            elif len(b) > LONG:
                out[i] = self._merge_long(b)
            else:
                by_width.setdefault(1 << (len(b) - 2).bit_length() if len(b) > 2 else 1, []).append(i)
        for width, which in by_width.items():
            for at in range(0, len(which), max(1, 2_000_000 // width)):
                part = which[at : at + max(1, 2_000_000 // width)]
                for i, ids in zip(part, self._merge_rows([raw[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        """One segment tree of ``width`` leaves for each piece of 2 to ``width + 1`` bytes."""
        n = len(rows)
        lens = np.fromiter(map(len, rows), np.int64, n)
        flat = np.frombuffer(b"".join(rows), np.uint8)
        inside = np.arange(width + 1) < lens[:, None]
        data = np.zeros((n, width + 1), np.int64)
        data[inside] = flat
        symbol = self.first[data]
        every = np.arange(n)
        symbol[every, lens - 1] = self.last[data[every, lens - 1]]
        after = np.broadcast_to(np.arange(1, width + 2), (n, width + 1)).copy()
        before = after - 2
        alive = inside.copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        rank = self.ranks(symbol[:, :-1], symbol[:, 1:])
        leaf = np.where((rank >= 0) & inside[:, 1:], rank * width + np.arange(width), NONE)
        tree[:, width:] = leaf
        level = width // 2
        while level:
            tree[:, level : 2 * level] = tree[:, 2 * level : 4 * level].reshape(n, level, 2).min(axis=2)
            level //= 2
        row = every[tree[:, 1] != NONE]
        while len(row):
            rank, j = np.divmod(tree[row, 1], width)
            gone = after[row, j]
            then = after[row, gone]
            symbol[row, j] = made = self.made[rank]
            alive[row, gone] = False
            after[row, j] = then
            more = then < lens[row]
            before[row[more], then[more]] = j[more]
            ahead = before[row, j]
            left = ahead >= 0
            self._put(tree, row, gone, np.full(len(row), -1), width)
            self._put(tree, row, j, np.where(more, self.ranks(made, symbol[row, np.minimum(then, width)]), -1), width)
            if left.any():
                self._put(tree, row[left], ahead[left], self.ranks(symbol[row[left], ahead[left]], made[left]), width)
            row = row[tree[row, 1] != NONE]
        counts = alive.sum(axis=1)
        return np.split(symbol[alive], np.cumsum(counts)[:-1])

    @staticmethod
    def _put(tree: np.ndarray, row: np.ndarray, leaf: np.ndarray, rank: np.ndarray, width: int) -> None:
        """Point update of one leaf in each row."""
        fits = leaf < width  # the last symbol begins no pair
        row, leaf, rank = row[fits], leaf[fits], rank[fits]
        at = leaf + width
        tree[row, at] = np.where(rank >= 0, rank * width + leaf, NONE)
        at = at >> 1
        while len(at) and at[0]:
            tree[row, at] = np.minimum(tree[row, 2 * at], tree[row, 2 * at + 1])
            at = at >> 1

    def _merge_long(self, data: bytes) -> np.ndarray:
        symbol = self.first[np.frombuffer(data, np.uint8)]
        symbol[-1] = self.last[data[-1]]
        n = len(symbol)
        width = 1 << (n - 2).bit_length()
        rank = self.ranks(symbol[:-1], symbol[1:])
        none = int(NONE)
        tree = [none] * (2 * width)
        tree[width : width + n - 1] = np.where(rank >= 0, rank * width + np.arange(n - 1), NONE).tolist()
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        symbol, after, before = symbol.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        made, size, table_ = self.made.tolist(), self.size, self._pair_table()

        def put(leaf: int, key: int) -> None:
            at = leaf + width
            tree[at] = key
            at >>= 1
            while at:
                low = min(tree[2 * at], tree[2 * at + 1])
                if tree[at] == low:
                    break
                tree[at] = low
                at >>= 1

        def key_of(a: int, b: int) -> int:
            r = table_.get(symbol[a] * size + symbol[b])
            return none if r is None else r * width + a

        while tree[1] != none:
            rank_, j = divmod(tree[1], width)
            gone = after[j]
            then = after[gone]
            symbol[j], symbol[gone], after[j] = made[rank_], -1, then
            if gone < n - 1:
                put(gone, none)
            if then < n:
                before[then] = j
                put(j, key_of(j, then))
            else:
                put(j, none)
            if before[j] >= 0:
                put(before[j], key_of(before[j], j))
        return np.array([s for s in symbol if s >= 0], dtype=np.int64)

    def _pair_table(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), self.rank_at.tolist(), strict=True))
        return self._pairs

    def decode(self, ids: list[int]) -> str:
        """Text of a list of ids, special tokens kept: tokens joined by a space where the file names no
        decoder, else the bytes they stand for."""
        tokens = [self.token_of[i] for i in ids if i in self.token_of]
        if self.decoder is None:
            return " ".join(tokens)
        if self.decoder["type"] != "ByteLevel":
            return self.library.decode(list(ids), skip_special_tokens=False)
        return b"".join(bytes(self.byte_of[c] for c in t) if t not in self.special else t.encode() for t in tokens).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def merger(path: str) -> Merger:
    return Merger(path)


class PieceCache:
    """Values of pieces by ``make(pieces)``, for the pieces of the present batch and as many earlier ones as fit."""

    def __init__(self, make, fixed: dict | None = None):
        self.make, self.fixed = make, fixed or {}
        self.known: dict = dict(self.fixed)

    def of(self, lists: list[list[str]]) -> dict:
        wanted = set().union(*lists) if lists else set()
        missing = [p for p in wanted if p not in self.known]
        if len(self.known) - len(self.fixed) + len(missing) > CACHE:
            self.known = {**self.fixed, **{p: self.known[p] for p in wanted if p in self.known}}
        self.known.update(zip(missing, self.make(missing), strict=True))
        return self.known


def text_batches(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in order, in lists of about ``BATCH_CHARS`` characters; null counts as empty."""
    part, chars = [], 0
    for t in texts:
        part.append(t or "")
        chars += len(part[-1])
        if chars >= BATCH_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


OUTPUTS = {
    "n_tokens": pa.int64(),
    "ids": pa.list_(pa.int32()),
    "decoded": pa.string(),
    "ids_sha256": pa.string(),
    "decoded_sha256": pa.string(),
}
SQL_TYPES = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """One row per input row: ``doc_id`` and the chosen ``outputs``.

    ``ids`` are the tokens of the whole text without begin and end tokens; ``decoded`` is the
    text decoded from them; the two digests are those of the ids as little-endian unsigned
    32-bit integers and of the decoded text in UTF-8. Null text counts as empty: no tokens,
    empty decoded text. Strings of special tokens in a text become those tokens, as the
    library has it. Null or repeated ids pass through. Other columns are not read.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        joined = own.decoder is None

        def make(pieces: list[str]) -> list[tuple[bytes, bytes]]:
            found = own.encode_pieces(pieces)
            return [(ids.astype("<u4").tobytes(), (" ".join(map(own.token_of.__getitem__, ids.tolist())) if joined else "").encode()) for ids in found]

        cache = PieceCache(make)
        schema = pa.schema([("doc_id", pa.int64()), *((o, OUTPUTS[o]) for o in outputs)])
        for batch in batches:  # bounded by bytes
            got: dict[str, list] = {o: [] for o in outputs}
            for texts in text_batches(batch.column(1).to_pylist()):
                split = [own.pieces(t) for t in texts]
                known = cache.of(split)
                for pieces in split:
                    values = [known[p] for p in pieces]
                    ids = b"".join([v[0] for v in values])
                    if "n_tokens" in got:
                        got["n_tokens"].append(len(ids) // 4)
                    if "ids" in got:
                        got["ids"].append(np.frombuffer(ids, "<u4").astype(np.int32))
                    if "ids_sha256" in got:
                        got["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    if "decoded" in got or "decoded_sha256" in got:
                        text = b" ".join([v[1] for v in values]) if joined else own.decode(np.frombuffer(ids, "<u4").tolist()).encode()
                        if "decoded" in got:
                            got["decoded"].append(text.decode())
                        if "decoded_sha256" in got:
                            got["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(got[o], OUTPUTS[o]) for o in outputs)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(bounded(encode, 1), "doc_id long, " + ", ".join(f"{o} {SQL_TYPES[o]}" for o in outputs))


def decode_ids(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of lists of ids; a null list gives null, an empty one an empty text, unknown ids are left out."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(decode, "doc_id long, text string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), default_path(), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
