"""Words of texts by number, and names of stretches of words, two of 64 bits each.

A word has two 64-bit names: its length and its bytes, eight at a time, go through a bijective
mixer in two lanes, so that words of up to eight bytes never share a name with others of their
length, and no pattern of letters cancels out. Stretches of one length are mixed word by word
in the same way; those of any length are polynomials modulo the prime 2^61 - 1.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
LONG_WORD = 4096
PRIME = (1 << 61) - 1
BASES = (0x0B4F3A96C1D7E285, 0x13C6EF372FE94F82)  # of the two lanes
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def word_names(data: bytes, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both names of the words ``data[first:last]``, eight bytes at a time; ``data`` has eight bytes more than the words."""
    eight = np.ndarray((max(len(data) - 7, 0),), "<u8", data, strides=(1,))  # the eight bytes from each place on
    size = last - first
    with np.errstate(over="ignore"):
        one, two = mixed(size.astype(U) + U(0x51)), mixed(size.astype(U) + U(0xA7 << 32))
        open_, at = np.arange(len(size)), 0
        while len(open_):
            left = size[open_] - at
            chunk = eight[first[open_] + at]
            short = left < 8
            chunk[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
            one[open_] = mixed(one[open_] * U(3) + chunk)
            two[open_] = mixed(two[open_] * U(0xD6E8FEB86659FD93) ^ mixed(chunk + U(0x2545F4914F6CDD1D)))
            at += 8
            open_ = open_[left > 8]
            if at == LONG_WORD:
                for i in open_.tolist():
                    name = xxhash.xxh3_128_intdigest(data[first[i] : last[i]])
                    one[i], two[i] = name & 0xFFFFFFFFFFFFFFFF, name >> 64
                break
    return one, two


class Slots:
    """The words of some texts in one row of slots, a separator before each text and after the last; ``hash`` and ``other`` are the two names of each."""

    def __init__(self, texts: list[bytes]):
        joined = b"".join([*texts, bytes(8)])
        data = np.frombuffer(joined, np.uint8)[:-8]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        apart = np.append(True, space)
        apart[ends - sizes] = True
        first = np.flatnonzero(~space & apart[:-1])
        apart = np.append(space, True)
        apart[ends] = True
        last = np.flatnonzero(~space & apart[1:]) + 1
        self.text_of = np.searchsorted(ends, first, side="right")
        n = len(first) + len(texts) + 1
        self.separator = np.ones(n, bool)
        at = np.arange(len(first)) + self.text_of + 1
        self.separator[at] = False
        self.hash, self.other = mixed(np.arange(n, dtype=U)), mixed(np.arange(n, dtype=U) + U(1 << 40))
        self.hash[at], self.other[at] = word_names(joined, first, last)
        self.begin = np.searchsorted(self.text_of, np.arange(len(texts))) + np.arange(len(texts)) + 1  # first slot of each text


def chained(values: np.ndarray, length: int) -> np.ndarray:
    """A name of each stretch of ``length`` values, by its start."""
    with np.errstate(over="ignore"):
        n = len(values) - length + 1
        out = mixed(values[: max(n, 0)] + U(length))
        for k in range(1, length if n > 0 else 0):
            out = mixed(out * U(3) + values[k : k + n])
    return out


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2^61 - 1 of numbers below 2^61."""
    low, high, low_b, high_b = a & U(0x7FFFFFFF), a >> U(31), b & U(0x7FFFFFFF), b >> U(31)
    middle = high * low_b + low * high_b
    return reduced(U(2) * (high * high_b) + (middle >> U(30)) + ((middle & U(0x3FFFFFFF)) << U(31)) + low * low_b)


def reduced(x: np.ndarray) -> np.ndarray:
    x = (x & U(PRIME)) + (x >> U(61))
    return np.where(x >= U(PRIME), x - U(PRIME), x)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^61 - 1, at least ``n`` of each."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(n, 1 << 17).bit_length()
        held = []
        for b in (base, pow(base, -1, PRIME)):
            up = np.ones(1, U)
            while len(up) < size:  # doubled: the second half is the first times a power
                up = np.concatenate([up, times(up, np.full(len(up), pow(b, len(up), PRIME), U))])
            held.append(up)
        held = _powers[base] = tuple(held)
    return held


def stretch_names(values: np.ndarray, base: int):
    """A function of starts and ends: a name of ``values[start:end]`` that depends on nothing else."""
    n = len(values)
    up, down = powers(base, n + 1)
    terms = times(reduced(values), up[:n])
    low = np.concatenate([np.zeros(1, U), np.cumsum(terms & U(0x7FFFFFFF), dtype=U)])
    high = np.concatenate([np.zeros(1, U), np.cumsum(terms >> U(31), dtype=U)])
    sums = reduced(reduced(low) + times(reduced(high), np.full(n + 1, 1 << 31, U)))

    def of(start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed(times(reduced(sums[end] + U(PRIME) - sums[start]), down[start]) + mixed((end - start).astype(U)))

    return of
