"""Token ids in wavelet matrices: one compressed file for each shard of documents.

A shard's ids are numbered densely; level by level, from the highest bit, one
bit of every id is written to a plane, and the ids are parted stably by that
bit for the next level.  The planes are cut into blocks that are compressed
each for itself, with the number of ones before each block in a directory.  So
one file answers which token stands at a place (access), how often an id occurs
in a stretch (count) and where it occurs (occurrences, by select), and reads no
more blocks than it needs.

``write_tokens`` deals documents to shards in the order of their ids and writes
one Parquet file a shard with Spark's own writer, whose commit survives lost
executors; the column ``matrix`` of its only row is the format below.
``read_tokens`` decodes the files and gives each document's ids back.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytetext import parts
from .frames import order_key, shared_folder
from .subwords import byte_encoder, pieces

#: Tokens of a shard, about; a longer document makes a longer shard.
SHARD = 1 << 20
#: Id of the token that ends each document.
END = 0
#: Bits of one block of a plane.
BLOCK = 1 << 16

_MAGIC = b"FLWM\x00\x00\x00\x01"
_HEAD = struct.Struct("<8sQQQQ")
_CODEC = pa.Codec("zstd", 1)
_ONES = np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int64)


def _packed(data: np.ndarray) -> bytes:
    raw = data.tobytes()
    return struct.pack("<Q", len(raw)) + (_CODEC.compress(raw, asbytes=True) if raw else b"")


def encode_shard(ids: np.ndarray, lengths: np.ndarray, keys: np.ndarray, known: np.ndarray) -> bytes:
    """The file of a shard: ids of all its documents, each document's length, doc_id, and whether that is given.

    Layout, little-endian: magic, number of ids, distinct ids, levels, documents;
    a table of section sizes; then, compressed, the distinct ids, lengths,
    doc_ids and marks of nulls, zeros of each level, ones before each block, and
    the blocks.
    """
    present = np.bincount(ids) > 0
    alphabet = np.flatnonzero(present)
    levels = max(1, int(len(alphabet) - 1).bit_length())
    now = (np.cumsum(present) - 1).astype(np.uint16 if levels <= 16 else np.uint32)[ids]
    n, per = len(ids), -(-len(ids) // BLOCK)
    zeros, ones, blocks = np.zeros(levels, np.int64), np.zeros((levels, per + 1), np.int64), []
    for level in range(levels):
        side = (now & np.array(1 << (levels - 1 - level), now.dtype)) != 0
        plane = np.packbits(side, bitorder="little")
        for i in range(per):
            part = plane[i * BLOCK // 8 : (i + 1) * BLOCK // 8]
            ones[level, i + 1] = ones[level, i] + _ONES[part].sum()
            blocks.append(_CODEC.compress(part.tobytes(), asbytes=True))
        zeros[level] = n - ones[level, per]
        now = now[np.concatenate([np.flatnonzero(~side), np.flatnonzero(side)])]
    sizes = np.array([len(b) for b in blocks], np.int64)
    head = [_packed(x) for x in (alphabet.astype(np.uint32), lengths.astype(np.int64), keys.astype(np.int64), known.astype(np.uint8), zeros, ones, sizes)]
    table = np.array([len(x) for x in head], np.int64).tobytes()
    return b"".join([_HEAD.pack(_MAGIC, n, len(alphabet), levels, len(lengths)), table, *head, *blocks])


class WaveletFile:
    """Reads one shard; blocks are decompressed when they are needed and the last ones are kept."""

    KEPT = 64

    def __init__(self, data: bytes) -> None:
        self.data = memoryview(data)
        magic, self.n, self.distinct, self.levels, self.documents = _HEAD.unpack_from(self.data)
        if magic != _MAGIC:
            raise ValueError("not a token file")
        sizes = np.frombuffer(self.data, np.int64, 7, _HEAD.size)
        at = _HEAD.size + 7 * 8
        kinds = (np.uint32, np.int64, np.int64, np.uint8, np.int64, np.int64, np.int64)
        found = []
        for size, kind in zip(sizes, kinds, strict=True):
            (raw,) = struct.unpack_from("<Q", self.data, at)
            found.append(np.frombuffer(_CODEC.decompress(self.data[at + 8 : at + size], raw), kind) if raw else np.zeros(0, kind))
            at += int(size)
        self.alphabet, self.lengths, self.keys, self.known, self.zeros, ones, blocks = found
        self.blocks_of_level = -(-self.n // BLOCK)
        self.ones = ones.reshape(self.levels, self.blocks_of_level + 1)
        self.ends = at + np.concatenate([[0], np.cumsum(blocks)])
        self._kept: dict[int, np.ndarray] = {}

    def _block(self, level: int, i: int) -> np.ndarray:
        """One block's bits, packed."""
        key = level * self.blocks_of_level + i
        if key not in self._kept:
            if len(self._kept) >= self.KEPT:
                self._kept.pop(next(iter(self._kept)))
            bits = min(BLOCK, self.n - i * BLOCK)
            self._kept[key] = np.frombuffer(_CODEC.decompress(self.data[self.ends[key] : self.ends[key + 1]], -(-bits // 8)), np.uint8)
        return self._kept[key]

    def _rank(self, level: int, place: int) -> int:
        """Ones among the first ``place`` bits of a level."""
        i, rest = divmod(place, BLOCK)
        if not rest:
            return int(self.ones[level, i])
        part = self._block(level, i)
        whole = int(_ONES[part[: rest // 8]].sum())
        return int(self.ones[level, i]) + whole + (int(part[rest // 8] & ((1 << rest % 8) - 1)).bit_count() if rest % 8 else 0)

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of a kind on a level."""
        before = self.ones[level] if bit else np.minimum(np.arange(self.blocks_of_level + 1) * BLOCK, self.n) - self.ones[level]
        i = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self._block(level, i), bitorder="little")[: self.n - i * BLOCK]
        return i * BLOCK + int(np.flatnonzero(bits == bit)[k - int(before[i])])

    def access(self, place: int) -> int:
        """The id at a place."""
        if not 0 <= place < self.n:
            raise IndexError(place)
        value = 0
        for level in range(self.levels):
            i, rest = divmod(place, BLOCK)
            bit = int(self._block(level, i)[rest // 8]) >> rest % 8 & 1
            ones = self._rank(level, place)
            place = int(self.zeros[level]) + ones if bit else place - ones
            value = value << 1 | bit
        return int(self.alphabet[value])

    def _span(self, token: int, first: int, last: int) -> tuple[int, int]:
        """Where the token's occurrences of places first to last (exclusive) lie below the last level."""
        value = int(np.searchsorted(self.alphabet, token))
        if value == len(self.alphabet) or self.alphabet[value] != token:
            return 0, 0
        for level in range(self.levels):
            a, b = self._rank(level, first), self._rank(level, last)
            zeros = int(self.zeros[level])
            first, last = (zeros + a, zeros + b) if value >> (self.levels - 1 - level) & 1 else (first - a, last - b)
        return first, last

    def count(self, token: int, first: int = 0, last: int | None = None) -> int:
        """Occurrences of an id from place ``first`` to before ``last``."""
        a, b = self._span(token, first, self.n if last is None else last)
        return b - a

    def occurrences(self, token: int, first: int = 0, last: int | None = None) -> list[int]:
        """Places of an id from ``first`` to before ``last``, ascending."""
        a, b = self._span(token, first, self.n if last is None else last)
        if a == b:
            return []
        value, out = int(np.searchsorted(self.alphabet, token)), []
        for place in range(a, b):
            for level in reversed(range(self.levels)):
                bit = value >> (self.levels - 1 - level) & 1
                place = self._select(level, bit, place - int(self.zeros[level]) * bit)
            out.append(place)
        return sorted(out)

    def tokens(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in reversed(range(self.levels)):
            plane = np.concatenate([self._block(level, i) for i in range(self.blocks_of_level)]) if self.n else np.zeros(0, np.uint8)
            side = np.unpackbits(plane, count=self.n, bitorder="little").view(np.bool_)
            above = np.empty_like(now)
            zeros = int(self.zeros[level])
            above[np.flatnonzero(~side)] = now[:zeros]
            above[np.flatnonzero(side)] = now[zeros:] | np.array(1 << (self.levels - 1 - level), now.dtype)
            now = above
        return self.alphabet[now]


def write_tokens(docs: DataFrame, tokenizer: str | None = None, shard: int = SHARD, path: str | None = None) -> str:
    """Encode every whole text, end it with ``END``, and write the shards; returns the folder.

    Documents stand in ascending order of doc_id, null ids last; equal ids are
    ordered by a hash of their texts, and rows that repeat wholly are
    documents of their own.  A null or empty text is just its end.  Strings of
    special tokens inside texts are those tokens, as the library reads them by
    default.  Columns besides doc_id and text are ignored; an empty table
    makes a folder without shards.
    """
    spark = docs.sparkSession
    path = path or f"{shared_folder(spark)}/floodlake-tokens-{uuid.uuid4().hex}"

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = byte_encoder(tokenizer)
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, seq
            ids, lengths, keys, known = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            size, seq = 0, seq + 1
            row = [[part], [seq - 1], [len(ids)], [len(lengths)], [encode_shard(ids, lengths, keys, known)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["part", "seq", "n_tokens", "n_docs", "matrix"])

        for batch in batches:
            key = batch.column("doc_id")
            all_keys, all_known = key.fill_null(0).to_numpy(zero_copy_only=False), key.is_valid().to_numpy(zero_copy_only=False)
            for row, data, text in parts(batch.column("text")):
                found, count = encoder.encode(pieces(row, data, text, marks=True))
                # The end token of each text stands behind its ids.
                ids = np.full(len(found) + len(count), END, np.int32)
                ids[np.arange(len(found)) + np.repeat(np.arange(len(count)), count)] = found
                lengths = count + 1
                ends = np.cumsum(lengths)
                first = 0
                while first < len(lengths):
                    begun = ends[first - 1] if first else 0
                    last = max(int(np.searchsorted(ends, begun + shard - size, side="left")) + 1, first + 1)
                    last = min(last, len(lengths))
                    held.append((ids[begun : ends[last - 1]], lengths[first:last], all_keys[row + first : row + last], all_known[row + first : row + last]))
                    size += int(ends[last - 1] - begun)
                    if size >= shard:
                        yield flush()
                    first = last
        if held:
            yield flush()

    # Equal rows, too, are dealt to several ranges: the last key tells them apart.
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", order_key(F.col("doc_id")).alias("ord"), F.col("doc_id").isNull().alias("last"), F.xxhash64("text").alias("mark"), F.rand(11).alias("salt"))
    dealt = keys.repartitionByRange("ord", "last", "mark", "salt").sortWithinPartitions("ord", "last", "mark", "salt").select("doc_id", "text")
    shards = dealt.mapInArrow(build, "part int, seq int, n_tokens long, n_docs long, matrix binary")
    shards.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, *, digests: bool = False) -> DataFrame:
    """From the files alone: doc_id, start (ids of all documents before), n_tokens, and ids, or ids_crc32 with ``digests``.

    ``ids_crc32`` is the crc32 of the ids as little-endian unsigned 32-bit integers.
    """

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, matrix in zip(batch.column("part"), batch.column("seq"), batch.column("matrix"), strict=True):
                file = WaveletFile(matrix.as_py())
                ids = file.tokens().astype("<u4")
                ends = np.cumsum(file.lengths)
                start = ends - file.lengths
                if digests:
                    raw = memoryview(ids).cast("B")
                    last = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), ends.tolist(), strict=True)], pa.int64())
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32)))
                n = len(start)
                key = pa.array(file.keys, mask=file.known == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part.as_py(), np.int32)), pa.array(np.full(n, seq.as_py(), np.int32)), key, pa.array(start), pa.array(file.lengths), last], names=["part", "seq", "doc_id", "within", "n_tokens", name])

    name, kind = ("ids_crc32", "long") if digests else ("ids", "array<int>")
    shards = spark.read.schema("part int, seq int, n_tokens long, n_docs long, matrix binary").parquet(path)
    # Ids before each shard: first before its part (one row a part meets in one task), then inside it.
    sizes = shards.select("part", "seq", "n_tokens")
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("base"))
    inside = Window.partitionBy("part").orderBy("seq")
    before = sizes.withColumn("before", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(by_part, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("before"))
    rows = shards.select("part", "seq", "matrix").mapInArrow(decode, f"part int, seq int, doc_id long, within long, n_tokens long, {name} {kind}")
    return rows.join(before, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", name)
