"""Token-id files as wavelet matrices, one compressed file per shard.

A shard holds the ids of consecutive documents. Plane by plane, from the highest bit, a bit per id is kept and the ids
are parted, zeros before ones, each side in order. A plane is stored packed, with the count of ones before every block
of 512 bits beside it: rank adds the ones of at most eight words to such a count, select finds its block by binary
search. So one file gives the id at a place, how often an id occurs before a place and where its occurrences are.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_folder, small_parts
from .tokens import encoder

MAGIC = b"TWWM2"
SHARD_TOKENS = 1 << 20
_HEAD = "<5sBQQ"
#: Words of a block of bits.
BLOCK = 8


def _parted(values: np.ndarray, one: np.ndarray) -> np.ndarray:
    ones, zeros = np.flatnonzero(one), np.flatnonzero(~one)
    out = np.empty_like(values)
    values.take(zeros, out=out[: len(zeros)], mode="clip")
    values.take(ones, out=out[len(zeros) :], mode="clip")
    return out


def encode(ids: np.ndarray, doc_ids: np.ndarray, sizes: np.ndarray) -> bytes:
    """The file of a shard: ids of its documents one after another; sizes: how many each has."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    parts = [np.asarray(doc_ids, "<i8").tobytes(), np.asarray(sizes, "<i8").tobytes()]
    kind = np.uint16 if bits <= 16 else np.uint32
    values = np.asarray(ids).astype(kind)
    for plane in range(bits - 1, -1, -1):
        one = (values & kind(1 << plane)) != 0
        packed = np.zeros(-(-len(ids) // (64 * BLOCK)) * BLOCK, "<u8")
        packed.view(np.uint8)[: -(-len(ids) // 8)] = np.packbits(one, bitorder="little")
        blocks = np.bitwise_count(packed).reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        parts += [packed.tobytes(), np.concatenate([[0], np.cumsum(blocks)]).astype("<u4").tobytes()]
        if plane:
            values = _parted(values, one)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    parts = [squeeze(p) for p in parts]
    return struct.pack(_HEAD, MAGIC, bits, len(ids), len(sizes)) + struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


class WaveletMatrix:
    """An opened file: planes of packed bits and their block counts, nothing else per id."""

    def __init__(self, data: bytes):
        magic, self.bits, self.n, docs = struct.unpack_from(_HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = struct.calcsize(_HEAD)
        lengths = struct.unpack_from(f"<{2 * self.bits + 2}Q", data, at)
        at += 8 * len(lengths)
        parts, open_ = [], zstandard.ZstdDecompressor().decompress
        for n in lengths:
            parts.append(open_(data[at : at + n]))
            at += n
        self.doc_ids, self.sizes = (np.frombuffer(p, "<i8", docs) for p in parts[:2])
        self.planes = [np.frombuffer(p, "<u8") for p in parts[2::2]]
        self.ranks = [np.frombuffer(p, "<u4") for p in parts[3::2]]
        self.zeros = [self.n - int(r[-1]) for r in self.ranks]

    @property
    def nbytes(self) -> int:
        return sum(p.nbytes + r.nbytes for p, r in zip(self.planes, self.ranks, strict=True))

    def all(self) -> np.ndarray:
        """Every id in order, by undoing the partings from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        for depth in range(self.bits - 1, -1, -1):
            one = np.unpackbits(self.planes[depth].view(np.uint8), count=self.n, bitorder="little").view(bool)
            nz, before = self.zeros[depth], np.empty_like(values)
            before[np.flatnonzero(~one)] = values[:nz]
            before[np.flatnonzero(one)] = values[nz:] | kind(1 << (self.bits - 1 - depth))
            values = before
        return values.astype(np.uint32)

    def _ones(self, depth: int, places: np.ndarray) -> np.ndarray:
        """How many ones of a plane stand before each place."""
        plane, word = self.planes[depth], places >> 6
        block = word // BLOCK
        found = self.ranks[depth][block].astype(np.int64)
        for i in range(BLOCK):
            at = block * BLOCK + i
            part = plane[np.minimum(at, len(plane) - 1)]
            below = (np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)
            found += np.where(at < word, np.bitwise_count(part), np.where(at == word, np.bitwise_count(part & below), 0))
        return found

    def _place(self, depth: int, ordinals: np.ndarray, bit: int) -> np.ndarray:
        """The places of the ones (bit 1) or zeros (bit 0) of a plane with these ordinals, from 0."""
        counts = self.ranks[depth].astype(np.int64)
        if not bit:
            counts = np.arange(len(counts)) * 64 * BLOCK - counts
        block = np.searchsorted(counts, ordinals, side="right") - 1
        out = np.empty(len(ordinals), np.int64)
        words = self.planes[depth].reshape(-1, BLOCK)
        for i in range(0, len(ordinals), 4096):
            own = block[i : i + 4096]
            cells = np.unpackbits(words[own].view(np.uint8), axis=1, bitorder="little") == bit
            out[i : i + 4096] = own * 64 * BLOCK + (np.cumsum(cells, axis=1, dtype=np.int16) > (ordinals[i : i + 4096] - counts[own])[:, None]).argmax(axis=1)
        return out

    def access(self, places: Sequence[int]) -> np.ndarray:
        """The ids at places."""
        at = np.asarray(places, np.int64)
        value = np.zeros(len(at), np.uint32)
        for depth in range(self.bits):
            bit = (self.planes[depth][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.uint32)
            ones = self._ones(depth, at)
            value, at = value << np.uint32(1) | bit, np.where(bit == 1, self.zeros[depth] + ones, at - ones)
        return value

    def _span(self, token: int, end: int) -> tuple[int, int]:
        """Where the ids equal to token among the first end ones lie behind the last plane."""
        if token < 0 or token >> self.bits or not self.n:
            return 0, 0
        ab = np.array([0, end])
        for depth in range(self.bits):
            ones = self._ones(depth, ab)
            ab = self.zeros[depth] + ones if token >> (self.bits - 1 - depth) & 1 else ab - ones
        return int(ab[0]), int(ab[1])

    def rank(self, token: int, end: int | None = None) -> int:
        """How often token occurs before place end."""
        a, b = self._span(token, self.n if end is None else end)
        return b - a

    def select(self, token: int, ordinals: Sequence[int] | None = None) -> np.ndarray:
        """The places of the occurrences of token with these ordinals, from 0 (all of them by default); -1 where there is none."""
        a, b = self._span(token, self.n)
        want = np.arange(b - a) if ordinals is None else np.asarray(ordinals, np.int64)
        there = (want >= 0) & (want < b - a)
        place = a + want[there]
        for depth in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - depth) & 1
            place = self._place(depth, place - self.zeros[depth] if bit else place, bit)
        out = np.full(len(want), -1, np.int64)
        out[there] = place
        return out


def _shards(make, end_id: int, shard_tokens: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, part, number, before = make(), TaskContext.get().partitionId(), 0, 0
        names: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def shard() -> pa.RecordBatch:
            nonlocal names, ids, sizes, held, number, before
            data = encode(np.concatenate(ids), np.concatenate(names), np.concatenate(sizes))
            row = [[part], [number], [before], [held], [sum(map(len, names))], [data]]
            names, ids, sizes, number, before, held = [], [], [], number + 1, before + held, 0
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "shard", "before", "tokens", "docs", "file"])

        for batch in small_parts(batches, 1):
            found, size = words.ids([t or "" for t in batch.column(1).to_pylist()])
            names.append(batch.column(0).to_numpy())
            sizes.append(size + 1)
            ids.append(np.insert(found, np.cumsum(size), np.uint32(end_id)))
            held += len(ids[-1])
            if held >= shard_tokens:
                yield shard()
        if names:
            yield shard()

    return build


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, lower: bool = True, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the ids of all documents to folder in ascending order of id_col, one file per shard: Spark's writer puts each shard
    into a file of its own, beside its number and counts (part and shard, in that order, order the shards), so that any
    store that Spark writes will do.

    A shard takes whole documents, about a megabyte of text at a time, until it has shard_tokens ids; so one very long
    text makes one large shard. Each document ends with end_id. A null text counts as empty. Rows without an id are left out; rows that repeat an id
    stand next to one another. Other columns are not read. An empty table gives an empty folder of shards.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    spread = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    files = spread.sortWithinPartitions("doc_id").mapInArrow(_shards(lambda: encoder(tokenizer_path, lower), end_id, shard_tokens), "part int, shard int, before long, tokens long, docs long, file binary")
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            m = WaveletMatrix(data.as_buffer())
            ids, starts = m.all().astype("<u4"), np.concatenate([[0], np.cumsum(m.sizes)])
            for i in range(0, len(m.sizes), 4096):
                span = range(i, min(i + 4096, len(m.sizes)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(m.doc_ids[i : i + 4096]), pa.array(starts[i : span.stop] + base), pa.array(m.sizes[i : i + 4096]), pa.array([ids[starts[k] : starts[k + 1]].tobytes() for k in span], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )


def _files(spark, folder: str) -> DataFrame:
    """base (ids of all shards before), file."""
    files = spark.read.parquet(folder)
    # One row per part; an exchange of these alone goes to one task.
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return files.join(bases, "part").select((F.col("before") + F.col("base")).alias("base"), "file")


def read_shards(spark, folder: str) -> DataFrame:
    """Per document of the files in folder: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian
    unsigned 32 bits)."""
    return _files(spark, folder).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")


def _occurrences(tokens: list[int]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                m = WaveletMatrix(data.as_buffer())
                starts = np.cumsum(m.sizes) - m.sizes
                for token in tokens:
                    places = m.select(token)
                    own = np.searchsorted(starts, places, side="right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(places), token, np.int64)), pa.array(m.doc_ids[own]), pa.array(places - starts[own])], ["token", "doc_id", "place"])

    return find


def occurrences(spark, folder: str, tokens: Sequence[int]) -> DataFrame:
    """token, doc_id, place (ids of the document before it) of every occurrence of the given ids, found by select alone."""
    return _files(spark, folder).mapInArrow(_occurrences([int(t) for t in tokens]), "token long, doc_id long, place long")


def _counts(tokens: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(1):
                m = WaveletMatrix(data.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([m.rank(t) for t in tokens], pa.int64())], ["token", "n"])

    return count


def counts(spark, folder: str, tokens: Sequence[int]) -> DataFrame:
    """token, n: how often each of the given ids occurs in all files, by rank alone."""
    return _files(spark, folder).mapInArrow(_counts([int(t) for t in tokens]), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def token_folder(spark) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
