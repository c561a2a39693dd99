"""Token ids in bit-plane or byte-plane blocks.

File format: a folder with

``blocks``
    Parquet, one row per block of ``BLOCK`` ids (a shard's last may be shorter).
    The ids are little-endian unsigned 32-bit numbers, transposed into planes
    (all first bytes, all second bytes, ...; or all lowest bits, ...), each
    plane compressed with zstandard. A row also says which documents start in the
    block, and which one reaches into it from before.
``index``
    Parquet, the chunk index: shard, block, start (place of the block's first id
    among all ids), n_ids, plane_bytes (compressed size of each plane).

A shard is one range of doc_id and shards are in doc_id order, so the ids of
all documents follow each other in ascending doc_id order. Spark's committer
writes the files: a task that is run again replaces what it had written.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.llm.common import KEPT, settled
from brindle.llm.tokens import LOWER, span_hash, span_sums, text_chunks

#: Ids of a block.
BLOCK = 1 << 16
#: Pieces whose ids a task remembers before it starts anew.
REMEMBERED = 1 << 19
LEVEL = 3
#: Bytes of the longest piece that is remembered; a multiple of 8.
LONGEST = 64
#: Bytes of text cut into pieces together.
TOGETHER = 1 << 19

_BLOCKS = (
    "shard int, block int, first long, n_ids int, carry_id long, carry_first long,"
    " doc_ids array<long>, doc_firsts array<long>, planes array<binary>"
)


#: Kinds of bytes. Words with an ``_ODD`` byte are encoded whole.
_BLANK, _LETTER, _DIGIT, _SIGN, _ODD = range(5)


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, _ODD, np.uint8)
    for b in range(33, 127):
        kinds[b] = _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN
    kinds[[32, 9, 10, 11, 12, 13]] = _BLANK
    kinds[ord("'")] = _ODD  # may start a contraction
    return kinds


def _words_at(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of ``raw`` on, as one number; it ends in 8 more bytes."""
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


def _same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether two pieces of equal size, up to ``LONGEST``, are equal byte by byte, 8 at a time."""
    same = np.ones(len(size), bool)
    for offset in range(0, LONGEST, 8):
        own = np.flatnonzero(size > offset)
        if not len(own):
            break
        unused = (8 * np.maximum(0, 8 - (size[own] - offset))).astype(np.uint64)
        same[own] &= (a[a_at[own] + offset] ^ b[b_at[own] + offset]) << unused == 0
    return same


class PieceCache:
    """Ids of texts, piece by piece.

    For tokenizers that drop white space, lower case, split letters, single
    digits and other signs from each other, and mark the last token of each piece
    with an end-of-word suffix. Texts are cut into such pieces with numpy: ASCII
    and the letters of Latin-1 are cut here; any other word (other characters,
    an apostrophe, a special token) is one piece that the tokenizer cuts itself.
    Each different piece is encoded once, letters many at a time as one text that
    is cut at its end-of-word tokens. Pieces are found by hash and their bytes are
    compared; one of more than ``LONGEST`` bytes, or that shares its hash with
    another, is encoded wherever it occurs. After ``REMEMBERED`` pieces all are
    forgotten. A Python worker keeps its cache from task to task of this kind.
    """

    _kept: dict[str, PieceCache] = KEPT.setdefault("pieces", {})

    @classmethod
    def of(cls, path: str) -> PieceCache:
        if path not in cls._kept:
            cls._kept.clear()
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = self.tokenizer.model.end_of_word_suffix
        if not suffix:
            raise ValueError("the tokenizer has no end-of-word suffix")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for word, k in vocabulary.items() if word.endswith(suffix)]] = True
        self.kinds = _byte_kinds()
        for token in self.tokenizer.get_added_tokens_decoder().values():
            self.kinds[token.content.encode()[0]] = _ODD
        self.forget()

    def forget(self) -> None:
        #: Sorted hashes of the pieces, and where each one's ids are in ``flat``.
        self.hashes, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.flat, self.first = np.zeros(0, np.uint32), np.zeros(1, np.int64)
        #: The bytes of each piece one after another, 8 more at the end, and where they start.
        self.bytes, self.at = np.zeros(8, np.uint8), np.zeros(1, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The row of each piece; -1: not known."""
        if not len(self.hashes):
            return np.full(len(hashes), -1, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.rows[at], -1)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, pieces: list[str]) -> list[np.ndarray]:
        parts, out = [pieces[k : k + 64] for k in range(0, len(pieces), 64)], []
        for part, ids in zip(parts, self._ids([" ".join(p) for p in parts]), strict=True):
            cuts = np.flatnonzero(self.ends[ids]) + 1
            out += np.split(ids, cuts[:-1]) if len(cuts) == len(part) else self._ids(part)
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], letters: np.ndarray) -> None:
        own = [np.flatnonzero(letters), np.flatnonzero(~letters)]
        order = np.concatenate(own).tolist()
        texts = [pieces[k].decode() for k in order]
        got = self._letters(texts[: len(own[0])]) + self._ids(texts[len(own[0]) :])
        known = len(self.first) - 1
        self.flat = np.concatenate([self.flat, *got])
        self.first = np.append(self.first, self.first[-1] + np.cumsum([len(x) for x in got], dtype=np.int64))
        new = b"".join(pieces[k] for k in order) + bytes(8)
        self.bytes = np.concatenate([self.bytes[:-8], np.frombuffer(new, np.uint8)])
        self.at = np.append(self.at, self.at[-1] + np.cumsum([len(pieces[k]) for k in order], dtype=np.int64))
        both = np.concatenate([self.hashes, hashes[np.concatenate(own)]])
        rows = np.concatenate([self.rows, np.arange(known, known + len(got), dtype=np.int32)])
        order = np.argsort(both, kind="stable")
        self.hashes, self.rows = both[order], rows[order]

    def encode(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids of the texts one after another, ids of each text) of parts of a column."""
        for _, raw, text_starts in text_chunks(column, TOGETHER):
            if len(self.hashes) > REMEMBERED:
                self.forget()
            kinds, low = self.kinds[raw], LOWER[raw]
            # Letters of two bytes, 0xC3 and one more, but for the signs of times and division.
            lead = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7))
            kinds[lead] = kinds[lead + 1] = _LETTER
            low[lead + 1] += np.where(raw[lead + 1] < 0x9F, 32, 0).astype(np.uint8)
            filled = kinds != _BLANK
            first_of_word = filled.copy()
            first_of_word[1:] &= ~filled[:-1]
            last_of_word = filled[:-1] & ~filled[1:]  # the last byte is a blank
            word_starts, word_ends = np.flatnonzero(first_of_word), np.flatnonzero(last_of_word) + 1
            if not len(word_starts):
                yield np.zeros(0, np.uint32), np.zeros(len(text_starts), np.int64)
                continue
            odd = np.logical_or.reduceat(kinds == _ODD, word_starts)
            cut = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
            for word in np.flatnonzero(odd).tolist():
                span = slice(word_starts[word], word_ends[word])
                cut[word_starts[word] : word_ends[word] - 1] = False
                low[span] = raw[span]
            starts_here = first_of_word
            starts_here[1:] |= cut & filled[1:]
            starts = np.flatnonzero(starts_here)
            # A piece ends where the next one starts, or before at its word's end.
            word = np.searchsorted(word_ends, starts, "right")
            ends = np.minimum(np.append(starts[1:], len(raw)), word_ends[word])
            with np.errstate(over="ignore"):
                sums, down = span_sums(low)
                hashes = span_hash(sums, down, starts, ends)
            del sums
            padded = np.append(low, np.zeros(8, np.uint8))
            data, view, size = low.tobytes(), _words_at(padded), ends - starts
            short = np.flatnonzero(size <= LONGEST)
            inverse, unique = pd.factorize(hashes[short])
            where = np.empty(len(unique), np.int64)
            where[inverse[::-1]] = short[::-1]
            # Each piece is compared with the first one of its hash, and that with the one known.
            first = where[inverse]
            same = size[first] == size[short]
            same[same] = _same_bytes(view, starts[short[same]], view, starts[first[same]], size[short[same]])
            rows = self._find(unique)
            new = np.flatnonzero(rows < 0)
            old = np.flatnonzero(rows >= 0)
            if len(new):
                place = where[new]
                pieces = [data[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
                self._learn(unique[new], pieces, (kinds[starts[place]] == _LETTER) & ~odd[word[place]])
                rows = self._find(unique)
            known = np.ones(len(unique), bool)
            known[old] = self.at[rows[old] + 1] - self.at[rows[old]] == size[where[old]]
            old = old[known[old]]
            known[old] = _same_bytes(_words_at(self.bytes), self.at[rows[old]], view, starts[where[old]], size[where[old]])
            row = np.full(len(starts), -1, np.int64)
            row[short] = np.where(same & known[inverse], rows[inverse], -1)
            alone = np.flatnonzero(row < 0)
            got = self._ids([data[a:b].decode() for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]) if len(alone) else []
            sizes = self.first[row + 1] - self.first[row]
            sizes[alone] = [len(x) for x in got]
            total = np.append(0, np.cumsum(sizes))
            source = np.repeat(self.first[row] - total[:-1], sizes) + np.arange(total[-1])
            if len(alone):
                # Their ids follow the remembered ones for this part alone.
                flat = np.concatenate([self.flat, *got])
                at = len(self.flat) + np.append(0, np.cumsum(sizes[alone]))
                for k, piece in enumerate(alone.tolist()):
                    source[total[piece] : total[piece + 1]] = np.arange(at[k], at[k + 1])
            else:
                flat = self.flat
            yield flat[source], np.diff(total[np.append(np.searchsorted(starts, text_starts), len(starts))])


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The compressed planes of one block of uint32 ids."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        rows = np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        rows = raw.T
    press = zstandard.ZstdCompressor(level=LEVEL)
    return [press.compress(np.ascontiguousarray(row).tobytes()) for row in rows]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    """The ids that :func:`to_planes` was given; 4 planes hold bytes, 32 bits."""
    expand = zstandard.ZstdDecompressor()
    rows = [np.frombuffer(expand.decompress(p), np.uint8) for p in planes]
    if len(rows) == 4:
        return np.ascontiguousarray(np.stack(rows, axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(r, count=n, bitorder="little") for r in rows], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


def _write_task(path: str, end_id: int, bits: bool) -> Callable:
    """(doc_id, text) in order -> the blocks of one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = PieceCache.of(path), TaskContext.get().partitionId()
        pending, size = [], 0  # ids not yet in a block
        starts: list[tuple[int | None, int]] = []  # documents that start in what is pending: id, place
        block, done, carry = 0, 0, (None, -1)

        def close(n: int) -> pa.RecordBatch:
            nonlocal pending, size, starts, block, done, carry
            data = np.concatenate(pending)
            ids, rest = data[:n], data[n:]
            own = [s for s in starts if s[1] < done + n]
            row = {"shard": shard, "block": block, "first": done, "n_ids": n, "carry_id": carry[0], "carry_first": carry[1], "doc_ids": [s[0] for s in own], "doc_firsts": [s[1] for s in own], "planes": to_planes(ids, bits)}
            starts = starts[len(own) :]
            carry = own[-1] if own else carry
            pending, size, block, done = [rest], size - n, block + 1, done + n
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in settled(batches, "pieces"):
            keys, row = batch.column(0).to_pylist(), 0
            for ids, counts in encoder.encode(batch.column(1)):
                ends = np.cumsum(counts)
                firsts = done + size + np.append(0, ends[:-1]) + np.arange(len(counts))
                starts += zip(keys[row : row + len(counts)], firsts.tolist(), strict=True)
                row += len(counts)
                pending.append(np.insert(ids, ends, end_id))
                size += len(ids) + len(counts)
                while size >= BLOCK:
                    yield close(BLOCK)
        if size:
            yield close(size)

    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("carry_id", pa.int64()), ("carry_first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_firsts", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary()))])
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", bits: bool = False) -> None:
    """Encode every whole text, in ascending order of id, into ``folder``.

    A null text counts as an empty one; every document ends with ``end_id``.
    Null ids come first; rows of one id follow each other, by text. An empty
    table makes a store without blocks. Texts are shuffled once, into ranges of
    ids and, where many rows have one id, of the texts' first characters; a task
    holds one block and one batch of rows.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = own.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    blocks = ordered.mapInArrow(_write_task(tokenizer, end_id, bits), T._parse_datatype_string(_BLOCKS))
    blocks.write.mode("overwrite").option("compression", "none").parquet(f"{folder}/blocks")
    written = docs.sparkSession.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    sizes = F.transform("planes", lambda p: F.octet_length(p))
    index = written.select("shard", "block", "first", "n_ids", sizes.alias("plane_bytes")).join(_shard_starts(written), "shard")
    index.select("shard", "block", (F.col("shard_start") + F.col("first")).alias("start"), "n_ids", "plane_bytes").write.mode("overwrite").parquet(f"{folder}/index")


def _shard_starts(blocks: DataFrame) -> DataFrame:
    """(shard, shard_start): ids of all shards before; one row a shard."""
    sums = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks -> for each part of a document its place, ids and checksum."""
    names = ("shard", "doc_first", "doc_id", "at", "n", "crc")
    for batch in batches:
        out: dict[str, list] = {k: [] for k in names}
        for row in batch.to_pylist():
            raw = memoryview(from_planes(row["planes"], row["n_ids"]).astype("<u4").tobytes())
            first, last = row["first"], row["first"] + row["n_ids"]
            starts = list(zip(row["doc_ids"], row["doc_firsts"], strict=True))
            if not starts or starts[0][1] > first:
                starts.insert(0, (row["carry_id"], row["carry_first"]))
            ends = [start for _, start in starts[1:]] + [last]
            for (key, start), end in zip(starts, ends, strict=True):
                low = max(start, first)
                for name, value in zip(names, (row["shard"], start, key, low, end - low, zlib.crc32(raw[4 * (low - first) : 4 * (end - first)])), strict=True):
                    out[name].append(value)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int32()), *((k, pa.int64()) for k in names[1:])]))


_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, bits reversed."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = (b >> 1) ^ _POLYNOMIAL if b & 1 else b >> 1
    return out


def crc32_join(crc: int, more: int, n_bytes: int) -> int:
    """The crc32 of two byte strings from the crc32 of each and the second's length."""
    shift, square = 1 << 31, 1 << 23  # x**0 and x**8
    while n_bytes:
        if n_bytes & 1:
            shift = _times(square, shift)
        square = _times(square, square)
        n_bytes >>= 1
    return _times(shift, crc) ^ more


@F.pandas_udf(T.LongType())
def _joined(parts: pd.Series) -> pd.Series:
    """The checksum of each document from those of its parts, in order."""
    out = []
    for own in parts:
        crc = own[0]["crc"]
        for part in own[1:]:
            crc = crc32_join(crc, part["crc"], 4 * part["n"])
        out.append(crc)
    return pd.Series(out, dtype="int64")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a store.

    Blocks are decoded where they are read, in any order and number of tasks. A
    document that lies in several blocks gets its checksum from theirs, so not
    even one document's ids come together in memory.
    """
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")
    pieces = blocks.mapInArrow(_pieces, "shard int, doc_first long, doc_id long, at long, n long, crc long")
    docs = pieces.groupBy("shard", "doc_first").agg(
        F.min("doc_id").alias("doc_id"),
        F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("at", "n", "crc"))).alias("parts"),
    )
    start = F.col("shard_start") + F.col("doc_first")
    return docs.join(_shard_starts(blocks), "shard").select("doc_id", start.alias("start"), "n_tokens", _joined("parts").alias("ids_crc32"))


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(start, ids) of every block: its ids and the place of the first among all."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{folder}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            ids = [from_planes(r["planes"], r["n_ids"]).astype(np.int64) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.list_(pa.int64()))], ["shard", "first", "ids"])

    found = blocks.mapInArrow(run, "shard int, first long, ids array<long>")
    return found.join(_shard_starts(blocks), "shard").select((F.col("shard_start") + F.col("first")).alias("start"), "ids")
