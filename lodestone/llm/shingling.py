"""Sets of word n-grams of Arrow text columns as 64-bit hashes, by numpy over the raw UTF-8 bytes.

Words are maximal runs of bytes other than space and tab to carriage return, A-Z taken as a-z; the
contracts' white space is ASCII, so that bytes and characters agree. A word's hash is a polynomial
over its bytes, taken for all words at once from prefix sums, and then mixed; an n-gram's hash is a
polynomial over the hashes of its words. No Python string is made."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once (one longer text alone), eight times that per array.
CHUNK = 1 << 18
_U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: Odd bases of the polynomials over bytes and over words.
BYTE_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_LETTER = mixed(np.arange(1, 257, dtype="u8") * _U(BYTE_BASE))
_LETTER[65:91] = _LETTER[97:123]
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """The first n or more powers of base modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        factors = np.full(max(n, CHUNK), base & (1 << 64) - 1, "u8")
        factors[0] = 1
        _powers[base] = np.cumprod(factors)
    return _powers[base]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and the offsets of its rows in them."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_string(column.type):
        kind = "i4"
    else:
        column, kind = column.cast(pa.large_string()), "i8"
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype("i8")
    return np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1"), at


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of texts side by side, and where each text's begin and end in them."""
    filled = ~_BLANK[data]
    first, last = filled.copy(), filled.copy()
    first[1:] &= ~filled[:-1]
    last[:-1] &= ~filled[1:]
    inner = at[(at > 0) & (at < len(data))]  # a text's end ends its word
    first[inner] = filled[inner]
    last[inner - 1] = filled[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(_LETTER[data] * _power(BYTE_BASE, len(data))[: len(data)], out=sums[1:])
    inverse = pow(BYTE_BASE, -1, 1 << 64)
    hashes = mixed((sums[ends] - sums[starts]) * _power(inverse, len(data) + 1)[starts])
    return hashes, np.searchsorted(starts, at)


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(max(0, len(h) - n + 1), "u8")
    for k in range(n):
        out = out * _U(WORD_BASE) + h[k : k + len(out)]
    return mixed(out)


def shingle_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes (int64) of its n-grams of words; of fewer words the whole
    sequence is the one gram, and without words there is none."""
    data, at = utf8(column)
    out: list[np.ndarray] = []
    row = 0
    while row < len(at) - 1:
        end = max(row + 1, int(np.searchsorted(at, at[row] + CHUNK, "right")) - 1)
        part = data[at[row] : at[end]]
        if not len(part):
            out += [np.zeros(0, "i8")] * (end - row)
            row = end
            continue
        hashes, where = _words(part, at[row : end + 1] - at[row])
        grams = _grams(hashes, n)
        for a, b in zip(where[:-1].tolist(), where[1:].tolist()):
            if b - a >= n:
                found = np.sort(grams[a : b - n + 1].view("i8"))
                out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
            else:
                # The count of words sets shorter sequences apart.
                short = _grams(hashes[a:b], b - a) + _U(b - a) if b > a else hashes[:0]
                out.append(mixed(short).view("i8"))
        row = end
    return out
