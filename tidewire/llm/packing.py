"""Sequence packing by minimum bin slack.

Every task packs the documents of its own partition, so that nothing is shuffled and a lost task is run again alone. A
document of more than one window gives full windows and a rest. The rests of a batch wait by length. A bitset dynamic
programme over the counts of waiting lengths finds which totals up to the window can be reached; the total closest to
the window is taken, the counts that reach it are found by going back through the programme, and that choice is used as
often as the counts allow. Choices that fill the window are used at once; the others wait for the next batch's rests. At
the end of a partition, and where many rests wait, the closest choice is used although it leaves a slack, which is filled
with a piece cut from one more rest; what is left of that rest waits on. So only the last sequence of a partition can be
padded.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_parts
from .tokens import encoder

WINDOW = 1024
#: Rests that wait until the programme runs; of those that fill no window together, four times as many may go on waiting.
BATCH_DOCS = 4096
#: Sequences of a partition are numbered from its number times this.
PER_PARTITION = 1 << 33

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def fill(counts: dict[int, int], window: int) -> tuple[int, dict[int, int]]:
    """The reachable total closest to window, not above it, and how many of each length make it."""
    full, reach = (1 << (window + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []  # length, how many at once, what was reachable before
    for length in sorted(counts, reverse=True):
        left, many = min(counts[length], window // length), 1
        while left > 0 and not reach >> window & 1:
            many = min(many, left)
            steps.append((length, many, reach))
            reach |= reach << (length * many) & full
            left, many = left - many, many * 2
        if reach >> window & 1:
            break
    total = at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + many
            at -= length * many
    return total, chosen


class Packer:
    """Takes documents one by one, gives pieces (doc, start, length, sequence, offset)."""

    def __init__(self, window: int, first: int = 0):
        self.window, self.next = window, first
        self.waiting: dict[int, deque] = {}
        self.count = 0

    def add(self, doc, tokens: int) -> Iterator[tuple]:
        whole, rest = divmod(tokens, self.window)
        for i in range(whole):
            yield doc, i * self.window, self.window, self.next, 0
            self.next += 1
        if rest:
            self.waiting.setdefault(rest, deque()).append((doc, tokens - rest))
            self.count += 1

    def exact(self) -> Iterator[tuple]:
        """Sequences that waiting rests fill to the brim."""
        while self.waiting:
            total, chosen = fill({k: len(v) for k, v in self.waiting.items()}, self.window)
            if total < self.window:
                return
            for _ in range(min(len(self.waiting[k]) // n for k, n in chosen.items())):
                yield from self._emit(chosen)

    def _emit(self, chosen: dict[int, int]) -> Iterator[tuple]:
        """A sequence of the chosen lengths and, if rests are left, of a piece of one of these in the slack."""
        offset = 0
        for length, n in chosen.items():
            for _ in range(n):
                doc, start = self.waiting[length].popleft()
                yield doc, start, length, self.next, offset
                offset += length
            if not self.waiting[length]:
                del self.waiting[length]
            self.count -= n
        slack = self.window - offset
        if slack and self.waiting:
            # Any rest left is longer than the slack, or it would have made the choice closer.
            length = max(self.waiting)
            doc, start = self.waiting[length].popleft()
            if not self.waiting[length]:
                del self.waiting[length]
            yield doc, start, slack, self.next, offset
            self.waiting.setdefault(length - slack, deque()).append((doc, start + slack))
        self.next += 1

    def rest(self, allowed: int = 0) -> Iterator[tuple]:
        """Sequences of what waits, each choice the closest to the window, until no more than allowed rests wait, or fewer ids
        than a window takes."""
        while self.count > allowed:
            total, chosen = fill({k: len(v) for k, v in self.waiting.items()}, self.window)
            if allowed and total < self.window and sum(chosen.values()) == self.count:
                return
            yield from self._emit(chosen)


def _packed(make, window: int, end_id: int, batch_docs: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = make(), Packer(window, TaskContext.get().partitionId() * PER_PARTITION)
        held: dict[int, list] = {}  # document -> its id, how many ids it has, where the ids not yet placed start, these ids

        def out(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = []
            for doc, start, length, sequence, offset in pieces:
                name, tokens, base, ids = held[doc]
                rows.append((name, start, length, ids[start - base : start - base + length].tobytes(), tokens, sequence, offset))
                if start + length == tokens:
                    del held[doc]
            for doc in {p[0] for p in pieces} & held.keys():  # only the rest of a document waits
                name, tokens, base, ids = held[doc]
                rest = tokens - tokens % window
                held[doc] = [name, tokens, rest, ids[rest - base :].copy()]
            for i in range(0, len(rows), 4096):
                cols = list(zip(*rows[i : i + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int64()) for k, c in enumerate(cols)], [x.split()[0] for x in PIECES.split(", ")])

        seen = waited = 0
        for batch in small_parts(batches, 1):
            ids, sizes = encode.ids([t or "" for t in batch.column(1).to_pylist()])
            pieces: list[tuple] = []
            for name, own in zip(batch.column(0).to_pylist(), np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                own = np.append(own, np.uint32(end_id)).astype("<u4")
                held[seen] = [name, len(own), 0, own]
                pieces += packer.add(seen, len(own))
                seen += 1
            if packer.count >= waited + batch_docs:
                pieces += packer.exact()
                waited = packer.count
                if waited > 4 * batch_docs:
                    pieces += packer.rest(batch_docs)
                    waited = packer.count
            yield from out(pieces)
        yield from out([*packer.exact(), *packer.rest()])

    return pack


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = 0, lower: bool = False, id_col: str = "doc_id", text_col: str = "text", batch_docs: int = BATCH_DOCS) -> DataFrame:
    """Pieces of the documents' token ids in sequences of at most window ids: doc_id, start, length, ids (binary, little-endian
    unsigned 32 bits), doc_tokens (end_id included), sequence_id, offset.

    Each id of each document is in one piece; the pieces of a sequence follow without a gap. A null text counts as
    empty, and its document is the end id alone. Rows without an id are left out; rows that repeat an id are packed each
    on their own. Very long texts are encoded whole. Other columns are not read. Sequence ids hold for one reading of
    docs, which should be a table or a staged frame.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    return rows.mapInArrow(_packed(lambda: encoder(tokenizer_path, lower), window, end_id, batch_docs), PIECES)
