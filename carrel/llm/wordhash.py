"""Vectorised tokenizing and hashing of words, shared by the operators that run in Arrow batches."""

from __future__ import annotations

import hashlib

import numpy as np

#: Bytes of text that are hashed at once; bounds the size of the temporary arrays.
BLOCK = 1 << 20
U = np.uint64


def _table(word) -> bytes:
    return bytes((b + 32 if 65 <= b <= 90 else b) if word(b) else 32 for b in range(256))


#: Lower-case A-Z; words are runs without ASCII white space.
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Lower-case A-Z; words are runs of ASCII letters, digits and characters beyond ASCII.
ALNUM = _table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)


def normal(text: str | None, words: bytes) -> bytes:
    """UTF-8, lower-cased, with all that separates words as spaces."""
    return (text or "").encode("utf-8", "surrogatepass").translate(words)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """1, r, r^2, ... modulo 2^64, at least n of them."""
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 4096), 0x9E3779B97F4A7C15, U)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def block_hashes(a: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the words in an array of bytes."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    starts, lens = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, U), starts
    off = np.cumsum(lens) - lens
    b = a[is_word].astype(U) + U(1)
    b *= powers(int(lens.max()))[np.arange(len(b)) - np.repeat(off, lens)]
    return mix(np.add.reduceat(b, off) + lens.astype(U) * U(0xD6E8FEB86659FD93)), starts


def pieces(data: bytes):
    """data cut at spaces into blocks."""
    at = 0
    while len(data) - at > 2 * BLOCK:
        end = data.find(b" ", at + BLOCK)
        end = len(data) if end < 0 else end
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(datas: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of normal() texts one after the other, and the offset of each text's first word (and the end)."""
    out, counts, group, held = [], [], [], 0

    def flush():
        nonlocal group, held
        if group:
            a = np.frombuffer(b" ".join(group) + b" ", np.uint8)
            h, starts = block_hashes(a, a != 32)
            ends = np.cumsum([len(x) + 1 for x in group])
            out.append(h)
            counts.extend(np.diff(np.searchsorted(starts, ends), prepend=0).tolist())
            group, held = [], 0

    for d in datas:
        if len(d) > 2 * BLOCK:
            flush()
            n = 0
            for piece in pieces(d):
                a = np.frombuffer(piece, np.uint8)
                h, _ = block_hashes(a, a != 32)
                out.append(h)
                n += len(h)
            counts.append(n)
            continue
        group.append(d)
        held += len(d)
        if held >= BLOCK:
            flush()
    flush()
    offsets = np.concatenate(([0], np.cumsum(counts, dtype=np.int64))) if counts else np.zeros(1, np.int64)
    return (np.concatenate(out) if out else np.zeros(0, U)), offsets


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of consecutive word hashes; max(0, len(h) - k + 1) of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    p = powers(k + 1)
    g = np.zeros(n, U)
    for j in range(k):
        g += h[j : j + n] * p[j + 1]
    return mix(g)


def digest(data: bytes) -> bytes:
    """128 bits that stand for the sequence of words of a normal() text."""
    return hashlib.sha256(b" ".join(data.split())).digest()[:16]
