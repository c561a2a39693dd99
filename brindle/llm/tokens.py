"""Vectorised word hashing of Arrow text columns, for Python tasks.

The bytes of many short texts are hashed together: a running sum of
``table[byte] * BASE**place`` gives the polynomial hash of any span as a
difference of two sums, so no Python object is made for a word. Long texts can
be built whose polynomial hashes are equal whatever the base, so words of more
than ``LONGEST`` bytes, which are rare, get a BLAKE2 digest instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text hashed together; a longer text is hashed alone.
CHUNK = 1 << 18
#: Bytes of a word that is hashed with the others.
LONGEST = 32

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def constants(n: int, salt: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(salt * 0x632BE59BD9B4E019 & _MASK)) | np.uint64(1)


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()
#: What is not ASCII white space.
NOT_SPACE = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: ASCII letters and digits, and every byte of other characters.
LETTERS = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])

_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**k and BASE**-k modulo 2**64 for k below ``n``."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 2 * CHUNK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


@dataclass
class Words:
    """The words of texts ``first`` .. ``first + len(counts) - 1`` of a batch."""

    first: int
    #: Words of each text.
    counts: np.ndarray
    #: Hash of each word, and of its first bytes, text after text.
    hashes: np.ndarray
    prefixes: np.ndarray | None


def text_chunks(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, start of each text) of parts of a string column.

    Texts follow each other with one blank after each, which ends its last
    word. Null texts are empty. A part has ``most`` bytes (``CHUNK`` unless
    given), or is one longer text.
    """
    most = most or CHUNK
    if len(column) == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    _, raw_offsets, raw = column.buffers()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(raw_offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        cuts = offsets[first : last + 1] - offsets[first]
        yield first, np.insert(data[offsets[first] : offsets[last]], cuts[1:], 32), cuts[:-1] + np.arange(last - first)
        first = last


def span_sums(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`span_hash` needs to hash any span of ``text``."""
    up, down = _power_tables(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(constants(256, 1)[text] * up[: len(text)], out=sums[1:])
    return sums, down


def span_hash(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(column: pa.Array, word_bytes: np.ndarray = NOT_SPACE, prefix: int = 0) -> Iterator[Words]:
    """The hashed words of every text of a string column, A-Z in lower case.

    Words are maximal runs of bytes that ``word_bytes`` allows. ``prefix``:
    also hash the first so many bytes of each word. Null texts have no words.
    """
    for first, text, text_starts in text_chunks(column):
        text = LOWER[text]
        inside = np.zeros(len(text) + 1, np.int8)
        inside[1:] = word_bytes[text]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums, down = span_sums(text)
            hashes = span_hash(sums, down, starts, ends)
            for k in np.flatnonzero(ends - starts > LONGEST).tolist():
                hashes[k] = int.from_bytes(hashlib.blake2b(text[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
            prefixes = span_hash(sums, down, starts, np.minimum(starts + prefix, ends)) if prefix else None
        counts = np.diff(np.append(np.searchsorted(starts, text_starts), len(starts)))
        yield Words(first, counts, hashes, prefixes)
