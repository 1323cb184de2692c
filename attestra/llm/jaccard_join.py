"""Exact Jaccard self-join on word shingles by a partitioned universe and the pigeonhole principle.

Two sets at similarity 3/4 or more differ in at most a third as many tokens as the smaller
one has. So hash the tokens into more segments than that: some segment of both must agree.

* Size bands. A band has one number of segments; a set is cut by its own band's scheme and,
  if a smaller partner may lie in the band below, by that one's too.
* Segment subsets. The tokens of a set in one segment make one signature. Small bands and
  the last segments of large ones also index the one-deletion neighbourhoods: such a segment
  is worth two units, for it finds partners that differ there in one token.
* Cost-based allocation. A set needs ``H + 1`` units, ``H`` being the difference its size
  allows. Segments that no other set shares cost nothing and are allocated first; a set
  that meets its need by them has no partner and leaves. The others, nearly all of them
  near copies, allocate their cheapest shared segments next, and leave the dearest (a
  common passage, say) out as far as their spare units reach.
* Sets whose tokens leave too many segments empty (rare) are found by their least tokens:
  partners share one of the ``n / 4 + 1`` least.
* Verification counts the common shingles of whole sets, compared word by word as strings.
  Sets that stay and share a signature form candidate groups, by connected components over
  bucket members and leaders. A group is cut into blocks of bounded size; a cell counts the
  common shingles of its blocks through an inverted index and returns links that join what
  was apart, a spanning forest, never the pairs inside a group of copies. Every linked pair
  is in one group, so none is lost.

Equal sets are one node, named by two independent hashes of 64 bits; hashes choose candidates
and name equal sets, and never decide a link. Signatures travel as packed arrays, some 10 bytes each; a segment
that very many sets of one batch share is reduced to the batch's leader before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from attestra.llm.common import bounded, drop_written, join_uses, release, table, written
from attestra.llm.components import components
from attestra.llm.words import Slots, chained, mixed

U = np.uint64
SHINGLE = 5
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
TINY = 5  # sets up to this size differ from partners in one token at most: one segment will do
BATCH_BYTES, BATCH_TEXTS = 600_000, 4096
HOT = 256  # sets of one batch in one bucket
PER_PART, PER_SORT, LEAST_PARTS = 4_000_000, 600_000, 64  # signatures
BLOCK_TOKENS = 1_000_000
BROADCAST_ROWS = 400_000
LEADERS = 4
OWN, BELOW, FAILS = 0, 1, 2


def _edges() -> list[int]:
    edges = [1, TINY + 1]
    while edges[-1] < 1 << 40:
        edges.append(-(-3 * edges[-1] // 2))
    return edges


EDGES = np.array(_edges(), dtype=np.int64)


def _schemes() -> tuple[np.ndarray, np.ndarray]:
    """Of each band the number of segments and how many of them, the last ones, take deletions."""
    need = (EDGES[1:] - 1) // 3 + 1
    small = EDGES[1:] <= 72
    segments = np.where(small, -(-3 * need // 4) + 1, -(-5 * need // 4) + 3)
    segments[0] = 1
    return segments, np.where(small, segments, 1 + segments // 32)


SEGMENTS, ELASTIC = _schemes()


class Sets:
    """Distinct shingle sets of some texts, side by side: ``token``, a second name and ``text`` of each element, sorted."""

    def __init__(self, texts: list[bytes], seed: int):
        slots = Slots([t.translate(LOWER_TABLE) for t in texts])
        seps = np.concatenate([[0], np.cumsum(slots.separator)])
        whole = np.flatnonzero(seps[SHINGLE:] == seps[:-SHINGLE]) if len(slots.hash) >= SHINGLE else np.zeros(0, np.int64)
        words = np.bincount(slots.text_of, minlength=len(texts))
        text, token, second = [np.searchsorted(slots.begin, whole, side="right") - 1], [chained(slots.hash, SHINGLE)[whole]], [chained(slots.other, SHINGLE)[whole]]
        for n in range(1, SHINGLE):  # short texts have one shingle
            short = np.flatnonzero(words == n)
            if len(short):
                text.append(short), token.append(chained(slots.hash, n)[slots.begin[short]]), second.append(chained(slots.other, n)[slots.begin[short]])
        text, token, second = (np.concatenate(x) for x in (text, token, second))
        order = np.lexsort((token, text))
        token, second, text = token[order], second[order], text[order]
        same = (token[1:] == token[:-1]) & (text[1:] == text[:-1])
        if (same & (second[1:] != second[:-1])).any():  # two shingles of a text share a token
            order = np.lexsort((second, token, text))
            token, second, text = token[order], second[order], text[order]
            same = (token[1:] == token[:-1]) & (text[1:] == text[:-1])
        new = np.ones(len(token), bool)
        new[1:] = ~same | (second[1:] != second[:-1])
        self.token, self.second, self.text = token[new], second[new], text[new]
        self.size = np.bincount(self.text, minlength=len(texts))
        self.node, self.check = (self._names(x, salt + 2 * seed) for x, salt in ((self.token, 1), (self.second, 2)))

    def _names(self, tokens: np.ndarray, salt: int) -> np.ndarray:
        """A name of each set."""
        with np.errstate(over="ignore"):
            sums = np.zeros(len(self.size), U)
            np.add.at(sums, self.text, mixed(tokens + mixed(np.full(1, salt, U))))
            return mixed(sums + mixed(self.size.astype(U))).view(np.int64)


def _parts(values: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    part, size, at = [], 0, 0
    for i, t in enumerate(values.to_pylist()):
        part.append((t or "").encode())
        size += len(part[-1])
        if size >= BATCH_BYTES or len(part) == BATCH_TEXTS:
            yield at, part
            part, size, at = [], 0, i + 1
    if part:
        yield at, part


def signatures(sets: Sets) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``signature, text, role, weight`` of all segments, and the spare units ``text x role``."""
    band = np.searchsorted(EDGES, sets.size, side="right") - 1
    spare = np.zeros((len(sets.size), 2), np.int64)
    out: list[list[np.ndarray]] = [[], [], [], []]
    for role in (OWN, BELOW):
        scheme = band - role
        takes = (sets.size > 0) & (scheme >= 0)
        if role == BELOW:  # only if the band below has a size that can match
            takes &= 3 * sets.size <= 4 * (EDGES[band] - 1)
        scheme = np.maximum(scheme, 0)
        segments = np.where(takes, SEGMENTS[scheme], 0)
        start = np.cumsum(segments) - segments
        mine = takes[sets.text]
        token, text = sets.token[mine], sets.text[mine]
        with np.errstate(over="ignore"):
            kind = mixed(scheme.astype(U) + U(1 << 20))
            seg = (mixed(token ^ kind[text]) % segments[text].astype(U)).astype(np.int64)
            value = mixed(token + U(31))
            slot = start[text] + seg
            total = int(segments.sum())
            sums = np.zeros(total, U)
            np.add.at(sums, slot, value)
            count = np.bincount(slot, minlength=total)
            of = np.repeat(np.arange(len(segments)), segments)
            which = np.arange(total) - start[of]
            salt = kind[of] + mixed(which.astype(U) + U(7))
            elastic = which >= segments[of] - ELASTIC[scheme[of]]
            full = np.flatnonzero(count)
            units = np.where(elastic[full] & (count[full] > 1), 2, 1)
            sign = mixed(sums[full] + mixed(count[full].astype(U)) + salt[full])
            cut = np.flatnonzero(elastic[slot] & (count[slot] > 1))
            less = mixed(sums[slot[cut]] - value[cut] + mixed((count[slot[cut]] - 1).astype(U)) + salt[slot[cut]])
        for k, x in enumerate((np.concatenate([sign, less]), np.concatenate([of[full], text[cut]]), np.full(len(sign) + len(less), role), np.concatenate([units, np.ones(len(cut), np.int64)]))):
            out[k].append(x)
        need = (sets.size // 3 if role == OWN else (sets.size + EDGES[band] - 1) // 7) + 1
        spare[:, role] = np.where(takes, np.bincount(of[full], units, minlength=len(segments)).astype(np.int64) - need, 0)
        # Tiny sets have one segment worth two units, which is all they need.
        spare[(scheme == 0) & takes, role] = 0
    return (*(np.concatenate(x) for x in out), spare)


def least_tokens(sets: Sets, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``signature, text`` of the least tokens of sets that may match one of ``sizes``."""
    near = np.zeros(len(sets.size), bool)
    for n in sizes.tolist():
        near |= (4 * sets.size >= 3 * n) & (3 * sets.size <= 4 * n)
    rank = np.arange(len(sets.text)) - np.searchsorted(sets.text, sets.text)
    chosen = near[sets.text] & (rank <= sets.size[sets.text] // 4)  # tokens are sorted within their set
    with np.errstate(over="ignore"):
        return mixed(sets.token[chosen] + U(99)), sets.text[chosen]


ROWS = "part int, packed binary"
FOUND = "node long, hub long, cost int, role int, weight int"
ALWAYS = 63  # cost of a bucket that was reduced to leaders of batches


def pack(part: int, sign: np.ndarray, node: np.ndarray, flags: np.ndarray) -> tuple[int, bytes]:
    """48 bits of each signature, 16 bits for its place in the list of nodes and its flags."""
    nodes, at = np.unique(node, return_inverse=True)
    head = np.array([0, len(sign), len(nodes)], np.uint32).tobytes()
    return part, b"".join([head, (sign >> U(32)).astype(np.uint32).tobytes(), ((sign >> U(16)) & U(0xFFFF)).astype(np.uint16).tobytes(), (at.astype(np.uint16) | (flags << 12).astype(np.uint16)).tobytes(), nodes.tobytes()])


def hub_of(leader: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Buckets with one leader and about one size hang together."""
    with np.errstate(over="ignore"):
        return mixed(leader.view(U) + mixed(cost.astype(U) + U(5))).view(np.int64)


def pack_found(part: int, node: np.ndarray, hub: np.ndarray, role: np.ndarray, weight: np.ndarray) -> tuple[int, bytes]:
    head = np.array([1, len(node), 0], np.uint32).tobytes()
    return part, b"".join([head, node.tobytes(), hub.tobytes(), role.astype(np.int32).tobytes(), weight.astype(np.int32).tobytes()])


def unpack(data: bytes) -> tuple:
    kind, n, m = np.frombuffer(data, np.uint32, 3).tolist()
    at = 12
    if kind:
        node, leader = np.frombuffer(data, np.int64, n, at), np.frombuffer(data, np.int64, n, at + 8 * n)
        return 1, node, leader, np.frombuffer(data, np.int32, n, at + 16 * n), np.frombuffer(data, np.int32, n, at + 20 * n)
    sign = (np.frombuffer(data, np.uint32, n, at).astype(U) << U(16)) | np.frombuffer(data, np.uint16, n, at + 4 * n)
    place = np.frombuffer(data, np.uint16, n, at + 6 * n)
    nodes = np.frombuffer(data, np.int64, m, at + 8 * n)
    return 0, sign, nodes[place & 0xFFF], (place >> 12).astype(np.int64), None


def _packed(sign: np.ndarray, node: np.ndarray, flags: np.ndarray, parts: int) -> Iterator[tuple[int, bytes]]:
    if not len(sign):
        return
    part = ((sign & U(0xFFFF)) * U(parts) >> U(16) if parts <= 0xFFFF else mixed(sign) % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, sign, node, flags = part[order], sign[order], node[order], flags[order]
    cuts = np.flatnonzero(np.diff(part, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield pack(int(part[a]), sign[a:b], node[a:b], flags[a:b])


def _gathered(sets: Sets) -> tuple[np.ndarray, ...]:
    """Signatures of a batch with node and flags, and its sets' spare units as debts, with node and kind."""
    sign, text, role, weight, spare = signatures(sets)
    named, at = np.unique(sets.node, return_index=True)
    at = at[sets.size[at] > 0]
    named = sets.node[at]
    fails = spare[at, OWN] < 0
    who = np.concatenate([named, named, named[fails]])
    kinds = np.concatenate([np.full(len(named), OWN), np.full(len(named), BELOW), np.full(int(fails.sum()), FAILS)])
    debts = np.concatenate([-spare[at, OWN], -spare[at, BELOW], sets.size[at][fails]])
    return sign, sets.node[text], role | (weight - 1) << 1, who, kinds, debts


def _batch_rows(gathered: list[tuple[np.ndarray, ...]], parts: int) -> Iterator[tuple[int, bytes]]:
    """Packed signatures of some batches by part; what a hot bucket among them already tells goes along as found."""
    sign, node, flags, who, kinds, debts = (np.concatenate(x) for x in zip(*gathered, strict=True))
    order = np.lexsort((node, sign))
    sign, node, flags = sign[order], node[order], flags[order]
    once = np.ones(len(sign), bool)
    once[1:] = (sign[1:] != sign[:-1]) | (node[1:] != node[:-1])
    sign, node, flags = sign[once], node[once], flags[once]
    start = np.flatnonzero(np.concatenate([[True], sign[1:] != sign[:-1]])) if len(sign) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(sign)))
    hot = np.repeat(size > HOT, size)
    if hot.any():
        leader = np.repeat(node[start], size)
        spread = int(mixed(node[:1].view(U))[0] % U(parts))
        yield pack_found(spread, node[hot], hub_of(leader[hot], np.full(int(hot.sum()), ALWAYS)), flags[hot] & 1, (flags[hot] >> 1) + 1)
        first = np.zeros(len(sign), bool)
        first[start] = True
        flags = flags | np.where(hot, 4, 0)
        keep = ~hot | first
        sign, node, flags = sign[keep], node[keep], flags[keep]
    yield from _packed(sign, node, flags, parts)
    # Debts go by node, so that copies meet and count once.
    part = (mixed(who.view(U)) % U(parts)).astype(np.int64)
    for p in np.unique(part).tolist():
        own = part == p
        yield p, np.array([2, int(own.sum()), 0], np.uint32).tobytes() + who[own].tobytes() + kinds[own].astype(np.int32).tobytes() + debts[own].astype(np.int32).tobytes()


def _close(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """What the signatures of one part tell: members of each bucket with its hub, and debts. Signatures are
    taken in ranges of about ``PER_SORT``, so that sorting them takes bounded memory."""
    total, debts, packed = 0, [], []
    for data in blobs:
        kind, n = np.frombuffer(data, np.uint32, 2).tolist()
        if kind == 2:
            debts.append(np.stack([np.frombuffer(data, np.int64, n, 12), np.frombuffer(data, np.int32, n, 12 + 8 * n), np.frombuffer(data, np.int32, n, 12 + 12 * n)]))
        elif kind == 1:
            _, node, hub, role, weight = unpack(data)
            yield _found(node, hub, np.full(n, ALWAYS), role, weight)
        else:
            total += n
            packed.append(data)
    ranges = -(-total // PER_SORT)
    for q in range(ranges):
        sign, node, flags = [], [], []
        for data in packed:
            _, s, v, f, _ = unpack(data)
            if ranges > 1:
                mine = (s >> U(20)) % U(ranges) == U(q)
                s, v, f = s[mine], v[mine], f[mine]
            sign.append(s), node.append(v), flags.append(f)
        s, v, f = np.concatenate(sign), np.concatenate(node), np.concatenate(flags)
        if not len(s):
            continue
        order = np.lexsort((v, s))
        s, v, f = s[order], v[order], f[order]
        once = np.ones(len(s), bool)
        once[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
        s, v, f = s[once], v[once], f[once]
        start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        size = np.diff(np.append(start, len(s)))
        cost = np.where(np.maximum.reduceat(f & 4, start) > 0, ALWAYS, np.log2(size).astype(np.int64))
        shared = np.repeat(size > 1, size)
        hub = hub_of(np.repeat(v[start], size)[shared], np.repeat(cost, size)[shared])
        f = f[shared]
        yield _found(v[shared], hub, np.repeat(cost, size)[shared], np.where(f & 8, FAILS, f & 1), ((f >> 1) & 1) + 1)
    if debts:
        d = np.unique(np.concatenate(debts, axis=1), axis=1)
        yield _found(d[0], d[0], np.full(d.shape[1], -1), np.where(d[1] == FAILS, 3, d[1]), d[2])


def _found(node: np.ndarray, hub: np.ndarray, cost: np.ndarray, role: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(hub), *(pa.array(x.astype(np.int32)) for x in (cost, role, weight))], names=["node", "hub", "cost", "role", "weight"])


def _meet(rows: DataFrame, parts: int) -> DataFrame:
    """Bring the packed rows of each part together and close it."""

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, blobs = None, []
        for batch in batches:
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if p != part and blobs:
                    yield from _close(blobs)
                    blobs = []
                part = p
                blobs.append(data)
        if blobs:
            yield from _close(blobs)

    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(close, FOUND)


def candidates(texts: DataFrame, parts: int, seed: int) -> DataFrame:
    """``node, hub, cost, role, weight``: members of buckets with more than one, by hub and size of bucket; rows of
    cost -1 are spare units as debts; role 3 names a set whose own units don't suffice, its size as weight."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            for p, data in _batch_rows(gathered, parts) if gathered else ():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([data], pa.binary())], names=["part", "packed"])

        for batch in batches:
            for _, part in _parts(batch.column(0)):
                if n + len(part) > BATCH_TEXTS:  # places in a list of nodes have 12 bits
                    yield from flush()
                    gathered, n = [], 0
                gathered.append(_gathered(Sets(part, seed)))
                n += len(part)
        yield from flush()

    return _meet(texts.select("text").mapInArrow(bounded(emit, 0), ROWS), parts)


def fallback_candidates(texts: DataFrame, sizes: list[int], parts: int, seed: int) -> DataFrame:
    """Candidates by least tokens for sets that may match one of ``sizes``."""
    wanted = np.array(sizes, np.int64)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _parts(batch.column(0)):
                sets = Sets(part, seed)
                sign, text = least_tokens(sets, wanted)
                if len(sign):
                    rows = list(_packed(sign, sets.node[text], np.full(len(sign), 8), parts))
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "packed"])

    return _meet(texts.select("text").mapInArrow(bounded(emit, 0), ROWS), parts)


def _named(texts: DataFrame, seed: int) -> DataFrame:
    """``doc_id, tag, n, node, check`` of each text, and its ``text_sha256`` if it is there."""
    more = texts.columns[3:]

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, node, check = [], [], []
            for _, part in _parts(batch.column(2)):
                sets = Sets(part, seed)
                size.append(sets.size), node.append(sets.node), check.append(sets.check)
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (size, node, check)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c.astype(np.int64)) for c in columns), *batch.columns[3:]], names=["doc_id", "tag", "n", "node", "check", *more])

    return texts.mapInArrow(bounded(name, 2), ", ".join(["doc_id long, tag long, n long, node long, check long", *(f"{c} string" for c in more)]))


class Places(dict):
    """Numbers from 1 of the words of a cell, compared as they are."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


def exact_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the shingle sets of some texts, and the numbers of their shingles, in order; equal numbers are equal words."""
    words = [t.translate(LOWER_TABLE).split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    padded = np.where(counts, np.maximum(counts, SHINGLE), 0)  # short texts end in zeros
    at = np.repeat(np.cumsum(padded) - padded - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    places = Places()
    number = np.zeros(int(padded.sum()), np.int64)
    number[at] = np.fromiter(map(places.__getitem__, chain.from_iterable(words)), np.int64, len(at))
    shingles = np.where(counts, padded - SHINGLE + 1, 0)
    text = np.repeat(np.arange(len(texts)), shingles)
    start = np.repeat(np.cumsum(padded) - padded - (np.cumsum(shingles) - shingles), shingles) + np.arange(shingles.sum())
    name = number[start]
    for k in range(1, SHINGLE):
        _, name = np.unique(name * (len(places) + 1) + number[start + k], return_inverse=True)
    kinds = int(name.max()) + 1 if len(name) else 1
    keys = np.unique(text * kinds + name)
    return np.bincount(keys // kinds, minlength=len(texts)), keys % kinds


def forest(nodes: np.ndarray, sizes: np.ndarray, names: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Links between the sets ``left`` and ``right`` (places in ``nodes``) that join what other links here don't.

    ``names`` are the numbers of the sets' elements, one set after another.
    """
    root = list(range(len(nodes)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    owner = np.repeat(np.arange(len(nodes)), sizes)
    start = np.cumsum(sizes) - sizes
    listed = np.zeros(len(nodes), bool)
    listed[right] = True
    mine = listed[owner]
    order = np.argsort(names[mine], kind="stable")
    posting, of = owner[mine][order], names[mine][order]
    cuts = np.searchsorted(of, np.arange(int(names.max()) + 2)) if len(names) else np.zeros(1, np.int64)
    links = []
    for x in left.tolist():
        own = names[start[x] : start[x] + sizes[x]]
        a, b = cuts[own], cuts[own + 1]
        size = b - a
        at = np.arange(size.sum()) + np.repeat(a - (np.cumsum(size) - size), size)
        if 16 * len(at) > len(nodes):
            common = np.bincount(posting[at], minlength=len(nodes))
            others = np.flatnonzero(common)
            common = common[others]
        else:
            others, common = np.unique(posting[at], return_counts=True)
        for y in others[100 * common >= 75 * (sizes[x] + sizes[others] - common)].tolist():
            p, q = find(x), find(y)
            if p != q:
                root[max(p, q)] = min(p, q)
                links.append((int(nodes[x]), int(nodes[y])))
    return links


LEFT, RIGHT = 1, 2


def _cell_links(cell: pa.Table) -> pa.Table:
    """Links between the left and the right sets of one cell, by their words."""
    cell = cell.combine_chunks()
    node, side = cell.column("node").to_numpy(), cell.column("side").to_numpy()
    sizes, names = exact_sets(cell.column("text").to_pylist())
    found = forest(node, sizes, names, np.flatnonzero(side & LEFT), np.flatnonzero(side & RIGHT))
    release()
    return pa.table({"root": pa.array([cell.column("root")[0].as_py()] * len(found), pa.int64()), "a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select("root", "i", "j", "side", "node", "text").groupBy("root", "i", "j").applyInArrow(_cell_links, "root long, a long, b long")


def _bucket_members(members: DataFrame, large: DataFrame, outside: DataFrame) -> DataFrame:
    """``root, node, weight, hub, left`` of sets of large groups; ``left`` marks those outside. Members of a bucket that was
    reduced to leaders of batches share no hub: such buckets count as one as far as they hang together."""
    mine = members.join(large.select("root", "node", "weight"), "node").join(outside.select("node", F.lit(True).alias("left")), "node", "left")
    mine = written(mine.select("root", "node", "weight", "hub", "cost", F.coalesce("left", F.lit(False)).alias("left")), "bucket-members")
    hot = mine.where(f"cost = {ALWAYS}")
    if not hot.take(1):
        return mine.drop("cost")
    tied = components(hot.select(F.col("node").alias("a"), F.col("hub").alias("b"))).withColumnRenamed("root", "hub")
    tied = hot.select("root", "node", "weight", "left").distinct().join(tied, "node")
    return written(mine.where(f"cost <> {ALWAYS}").drop("cost").unionByName(tied), "bucket-members")


def _bucket_cells(large: DataFrame, held: DataFrame, hubs: DataFrame) -> DataFrame:
    """Cells of buckets instead of whole groups: two sets that link share one. Small buckets are packed, large ones cut into blocks."""
    packs = hubs.where("blocks = 1").groupBy("root").agg(F.ceil(2 * F.sum("w") / BLOCK_TOKENS).alias("packs"))
    packs = F.broadcast(packs) if packs.count() <= BROADCAST_ROWS else packs
    known = written(hubs.join(packs, "root", "left").select("hub", "uses", "parts", "blocks", "packs"), "buckets")
    placed = join_uses(held, known, ["hub"], "uses")
    small = placed.where("blocks = 1").select("root", F.pmod(F.xxhash64("hub"), F.col("packs")).cast("int").alias("i"), F.lit(-1).alias("j"), F.when(F.col("left"), LEFT | RIGHT).otherwise(RIGHT).alias("side"), "node").distinct()
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    cut = placed.where("blocks > 1").withColumn("root", F.col("hub"))
    left = cut.where("left").select("root", one("parts").alias("i"), every("blocks").alias("j"), F.lit(LEFT).alias("side"), "node")
    right = cut.select("root", every("parts").alias("i"), one("blocks").alias("j"), F.lit(RIGHT).alias("side"), "node")
    return _cells(small.unionByName(left).unionByName(right).join(large.select("node", "text"), "node"))


def _links(sets: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """Links ``a, b`` inside candidate groups, by cells of bounded size.

    A group of one block is one cell. In a larger one a few leaders are first compared with every block; the sets
    that they join are one component, and only sets outside the largest such one are compared with others:
    a group of near copies of one text costs as much as it has rows. They meet the whole group or, where that sends
    fewer texts, the members of their buckets: groups grow faster than the corpus, for they hang together by chance.
    """
    leaders = F.array_distinct(F.array(*(F.min_by("node", F.xxhash64(F.lit(s), "node")) for s in range(LEADERS))))
    sized = groups.join(sets.select("node", "weight"), "node")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("weight") / BLOCK_TOKENS).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members"), leaders.alias("leaders")).where("members > 1")
    blocks = written(blocks, "blocks")
    placed = join_uses(groups, blocks.select("root", "blocks", "members"), ["root"], "members").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = sets.join(placed, "node").select("root", "node", "text", "weight", "blocks", "block")
    if not blocks.where("blocks > 1").take(1):
        return _cells(rows.select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(LEFT | RIGHT).alias("side"), "node", "text")).select("a", "b")
    rows = written(rows, "grouped-sets")
    single = rows.where("blocks = 1").select("root", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(LEFT | RIGHT).alias("side"), "node", "text")
    large = rows.where("blocks > 1")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    leading = blocks.where("blocks > 1").select("root", F.explode("leaders").alias("node")).join(large, ["root", "node"])
    leading = leading.select("root", every.alias("i"), F.lit(0).alias("j"), F.lit(LEFT).alias("side"), "node", "text")
    led = written(_cells(large.select("root", F.col("block").alias("i"), F.lit(0).alias("j"), F.lit(RIGHT).alias("side"), "node", "text").unionByName(leading)), "led")
    joined = components(led).withColumnRenamed("root", "part").join(large.select("root", "node"), "node")
    largest = joined.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("part", "n").alias("part"))
    inside = joined.join(F.broadcast(largest) if blocks.where("blocks > 1").count() <= BROADCAST_ROWS else largest, ["root", "part"], "left_semi").select("node")
    outside = written(large.join(inside, "node", "left_anti"), "outside")
    parts = outside.groupBy("root").agg(F.sum("weight").alias("lw"), F.ceil(F.sum("weight") / BLOCK_TOKENS).cast("int").alias("parts"))
    held = _bucket_members(members, large, outside)
    names = [F.bit_xor(F.xxhash64(*([F.lit(s)] * s), "node")).alias(f"name{s}") for s in (0, 1)]  # hubs of the same members are one
    hubs = held.groupBy("root", "hub").agg(F.count(F.lit(1)).alias("uses"), F.sum("weight").alias("w"), F.sum(F.when(F.col("left"), F.col("weight"))).alias("lw"), *names).where("uses > 1 AND lw > 0")
    hubs = hubs.groupBy("root", "uses", "name0", "name1").agg(F.min("hub").alias("hub"), F.min("w").alias("w"), F.min("lw").alias("lw"))
    hubs = written(hubs.withColumns({n: F.ceil(F.col(c) / BLOCK_TOKENS).cast("int") for n, c in (("parts", "lw"), ("blocks", "w"))}), "buckets")
    sent = hubs.groupBy("root").agg(F.sum(F.when(F.col("blocks") == 1, F.col("w")).otherwise(F.col("lw") * F.col("blocks") + F.col("w") * F.col("parts"))).alias("sent"))
    costs = parts.join(blocks.select("root", "blocks"), "root").join(sent, "root", "left")
    costs = written(costs.select("root", "parts", (F.coalesce("sent", F.lit(0.0)) < F.col("blocks") * (F.col("lw") + F.col("parts") * BLOCK_TOKENS)).alias("split")), "costs")
    small = costs.count() <= BROADCAST_ROWS
    few, split = (F.broadcast(x) if small else x for x in (costs.where("NOT split").select("root", "parts"), costs.where("split").select("root")))
    left = outside.join(few, "root").withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("root", "i", every.alias("j"), F.lit(LEFT).alias("side"), "node", "text")
    right = large.join(few, "root").select("root", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"), F.col("block").alias("j"), F.lit(RIGHT).alias("side"), "node", "text")
    found = _cells(single).unionByName(_cells(left.unionByName(right))).unionByName(_bucket_cells(large, held.join(split, "root", "left_semi"), hubs.join(split, "root", "left_semi")))
    return found.unionByName(led).select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", choose: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``; with ``choose`` also ``kept, text_sha256``.

    Shingles are of five words, A-Z lower-cased; texts of one to four words have their whole
    sequence as one. Texts without words, or null, have none and link with nothing. Texts
    link at 100 * common >= 75 * all shingles; ``component_id`` is the smallest id reachable
    by links, the document's own included. Rows that repeat an id are nodes of their own.
    Null ids link like others and are never the smallest; a component of null ids only has
    a null ``component_id``. An empty table gives an empty result. Other columns are not read.
    Of each component the text with the smallest id is kept, of several under that id, or
    under none, the one with the smallest digest; ``kept`` is true for all rows of that id and text.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("tag"), F.col(text_col).alias("text"))
    if choose:
        texts = texts.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    for seed in range(8):
        named = written(_named(texts, seed), "named")
        if not named.groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").take(1):
            break
        drop_written(named)
    else:
        raise RuntimeError("sets of different shingles share a 64-bit name under every seed")
    parts = max(LEAST_PARTS, int((named.agg(F.sum("n")).first()[0] or 0) * 0.8 / PER_PART) + 1)
    found = written(candidates(texts, parts, seed).groupBy("node", "hub", "cost", "role").agg(F.sum("weight").alias("weight")), "found")
    sizes = [r["weight"] for r in found.where("role = 3").select("weight").distinct().collect()]  # of sets cut too unevenly: a few sizes
    if sizes:
        more = fallback_candidates(texts, sizes, parts, seed).groupBy("node", "hub", "cost", "role").agg(F.sum("weight").alias("weight"))
        found = written(found.where("role < 3").unionByName(more), "found")
    roots = _component_roots(texts, named, found, seed)
    rooted = named.join(roots, "node", "left").withColumn("key", F.when(F.col("n") > 0, F.coalesce("root", "node")))
    rooted = written(rooted.select("doc_id", F.col("n").alias("n_shingles"), "key", *texts.columns[3:]), "rooted")
    linked, alone = rooted.where("key IS NOT NULL"), rooted.where("key IS NULL")
    order = F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_sha256") if choose else None
    least = linked.groupBy("key").agg(F.min("doc_id").alias("least"), *([F.min(order).alias("first")] if choose else []), F.count(F.lit(1)).alias("uses"))
    joined = join_uses(linked, written(least, "least"), ["key"], "uses").select("doc_id", "n_shingles", F.col("least").alias("component_id"), *([order.eqNullSafe(F.col("first")).alias("kept"), "text_sha256"] if choose else []))
    return joined.unionByName(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), *([F.lit(True).alias("kept"), "text_sha256"] if choose else [])))


def _component_roots(texts: DataFrame, named: DataFrame, found: DataFrame, seed: int) -> DataFrame:
    """``node, root`` of every node that links."""
    # A node stays if the units of its shared segments outweigh its spare ones, in either role.
    active = written(found.groupBy("node", "role").agg(F.sum("weight").alias("w")).where("w > 0").select("node").distinct(), "active")
    shared = found.where("cost >= 0").join(active, "node", "left_semi")
    # A set leaves its dearest buckets as far as its spare units reach. A pair meets in a bucket that the smaller set
    # keeps; the larger one is a member there in any case. Buckets that nobody keeps are dropped.
    spare = found.where(f"cost < 0 AND role = {OWN}").select("node", (-F.col("weight")).alias("spare"))
    dearest = Window.partitionBy("node").orderBy(F.desc("cost"), "hub")
    probes = shared.where(f"role = {OWN}").join(spare, "node").withColumn("left", F.sum("weight").over(dearest))
    kept = probes.where(f"left > spare OR cost = {ALWAYS}").select("hub").unionByName(shared.where(f"role = {FAILS} OR cost = {ALWAYS}").select("hub")).distinct()
    members = written(shared.join(kept, "hub", "left_semi").select("node", "hub", "cost").distinct(), "members")
    groups = components(members.select(F.col("node").alias("a"), F.col("hub").alias("b"))).join(active, "node", "left_semi")
    groups = written(groups, "groups")
    drop_written(found)
    several = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
    groups = written(groups.join(several, "root", "left_semi"), "groups")
    ids = named.join(groups.select("node"), "node", "left_semi").groupBy("node").agg(F.min_by(F.struct("doc_id", "tag"), F.struct(F.isnull("doc_id"), "doc_id", "tag")).alias("x")).select("node", F.col("x.doc_id").alias("x_id"), F.col("x.tag").alias("x_tag"))
    ids = written(ids, "group-texts")
    few = ids.count() <= BROADCAST_ROWS  # beyond it the texts are shuffled
    chosen = texts.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("tag") == F.col("x_tag")))
    # A set weighs as many shingles as it has words, so that a long text of few shingles is no light one.
    sets = written(chosen.select("node", F.encode("text", "UTF-8").alias("text"), F.greatest(F.lit(1), F.octet_length("text") / 5).alias("weight")), "sets")
    if sets.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1):  # equal rows without an id, or with one
        sets = written(sets.dropDuplicates(["node"]), "sets")
    return components(_links(sets, groups, members))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
    SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y)
SELECT r.x AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.y) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.x GROUP BY r.x
"""
