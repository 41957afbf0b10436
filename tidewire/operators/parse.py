"""Message texts to blocks, fields, sequence paths and diagnostics, in one pass over whole messages within a task.

A batch's texts are one array of bytes. Blocks are matched by the depth of their braces, block 4 up to the next -}; the few
steps per block are taken one by one. Fields are cut for all messages at once, by comparing bytes, so every position is a
byte offset in its message. The walk visits one by one the rows that open or close a sequence, once for messages that have the
same ones, and all rows where groups begin at anchor tags.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_MESSAGE_BYTES, MAX_BLOCK_BYTES, MAX_FIELDS, MAX_DEPTH = 10 * 1024 * 1024, 4 * 1024 * 1024, 10_000, 16
#: Bytes of text that are cut at once, or one message.
PART_BYTES = 4_000_000
BLOCKS = ("1", "2", "3", "4", "5")

_BRACE = re.compile(rb"[{}]")
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def closing_brace(text: bytes, start: int, end: int) -> int:
    """Where the brace at start is closed, or -1."""
    depth = 0
    for brace in _BRACE.finditer(text, start, end):
        depth += 1 if brace.group() == b"{" else -1
        if not depth:
            return brace.start()
    return -1


def blocks_of(text: bytes, start: int, end: int, limits: bool = True) -> tuple[dict[bytes, tuple[int, int]], tuple[str, int | None, str] | None]:
    """(id -> first and last byte of the content of the first block of that id, the defect that ends the reading: kind, place,
    detail)."""
    found: dict[bytes, tuple[int, int]] = {}
    if limits and end - start > MAX_MESSAGE_BYTES:
        return found, ("limit_message_bytes", None, str(end - start))
    at = start
    while (opened := text.find(b"{", at, end)) >= 0:
        if opened + 3 > end:
            return found, ("unclosed_block", opened, "")
        colon = text.find(b":", opened + 1, end)
        if colon < 0 or text.find(b"}", opened + 1, colon) >= 0:
            return found, ("missing_block_separator", opened, "")
        name = text[opened + 1 : colon]
        last = text.find(b"-}", colon + 1, end) if name == b"4" else closing_brace(text, opened, end)
        if last < 0:
            return found, ("unclosed_text_block" if name == b"4" else "unclosed_block", opened, "")
        at = last + 1 + (name == b"4")
        if limits and at - opened > MAX_BLOCK_BYTES:
            return found, ("limit_block_bytes", None, str(at - opened))
        found.setdefault(name, (colon + 1, last))
    return found, None


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The bytes from each start to its end, as strings."""
    lens = np.maximum(ends - starts, 0)
    upto = np.cumsum(lens)
    flat = data[np.repeat(starts - (upto - lens), lens) + np.arange(upto[-1] if len(upto) else 0)]
    return pa.StringArray.from_buffers(len(lens), pa.py_buffer(np.concatenate([[0], upto]).astype(np.int32)), pa.py_buffer(flat))


class Cut:
    """The blocks and fields of some messages, and what is wrong with them."""

    def __init__(self, bodies: pa.StringArray, limits: bool = True):
        n = len(bodies)
        bodies = pc.fill_null(bodies, "")
        offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + n + 1].astype(np.int64)
        # A slice of a batch has the whole batch's bytes; only its own are taken.
        self.text = bytes(memoryview(bodies.buffers()[2])[offsets[0] : offsets[-1]]) if n and bodies.buffers()[2] else b""
        offsets = offsets - offsets[0] if n else offsets
        self.data, self.offsets = np.frombuffer(self.text, np.uint8), offsets
        self.blocks, self.defects = [], []  # defects: message, kind, byte in the message, detail, expected
        for m, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            found, defect = blocks_of(self.text, a, b, limits)
            self.blocks.append(found)
            if defect:
                self.defects.append((m, defect[0], None if defect[1] is None else defect[1] - a, defect[2], None))
        self._fields(limits)

    def _fields(self, limits: bool) -> None:
        """message, tags and values of the fields, in order: a line of block 4 that begins with a tag of two to four letters or
        digits between colons begins one; other lines are its value's."""
        spans = [(m, *found[b"4"]) for m, found in enumerate(self.blocks) if b"4" in found]
        message, first, last = (np.array(x, np.int64) for x in (zip(*spans, strict=True) if spans else ([], [], [])))
        data = np.concatenate([self.data, np.zeros(6, np.uint8)])
        colon = np.flatnonzero(self.data == ord(":"))
        block = np.searchsorted(first, colon, side="right") - 1
        inside = (block >= 0) & (colon < last[np.maximum(block, 0)]) if len(first) else np.zeros(len(colon), bool)
        colon, block = colon[inside], block[inside]
        lines = (colon == first[block]) | (data[colon - 1] == ord("\n"))
        colon, block = colon[lines], block[lines]
        run, open_ = np.zeros(len(colon), np.int64), np.ones(len(colon), bool)
        for k in range(1, 6):
            open_ &= _LETTER[data[colon + k]]
            run += open_
        good = (run >= 2) & (run <= 4) & (data[colon + run + 1] == ord(":")) & (colon + run + 1 < last[block])
        bad_at, bad_block = colon[~good], block[~good]
        at, block, run = colon[good], block[good], run[good]
        heads = np.searchsorted(block, np.arange(len(first)))
        number = np.arange(len(at)) - heads[block]
        if limits and (number >= MAX_FIELDS).any():
            over = number == MAX_FIELDS
            self.defects += [(int(message[b]), "limit_fields", None, str(MAX_FIELDS + 1), None) for b in block[over]]
            stop = last.copy()
            stop[block[over]] = at[over]
            keep = bad_at < stop[bad_block]
            bad_at, bad_block = bad_at[keep], bad_block[keep]
            kept = number < MAX_FIELDS
            at, block, run = at[kept], block[kept], run[kept]
        self.defects += [(int(m), "malformed_field_tag", int(p), "", None) for m, p in zip(message[bad_block], bad_at - self.offsets[message[bad_block]], strict=True)]
        # The last field within the limit holds all that follows.
        ends = last[block]
        same = block[1:] == block[:-1]
        ends[:-1][same] = at[1:][same] - 1
        self.message, self.seq = message[block], np.arange(len(at)) - np.searchsorted(block, block) if len(at) else np.zeros(0, np.int64)
        self.tags = _slices(self.data, at + 1, at + 1 + run)
        self.values = pc.ascii_trim(_slices(self.data, at + run + 2, ends), " \t\n\f\r")
        self.lens = np.bincount(self.message, minlength=len(self.blocks))

    def block(self, name: str) -> pa.StringArray:
        """The content of each message's block, null where there is none."""
        own = [found.get(name.encode(), (0, 0)) for found in self.blocks]
        starts, ends = np.array(own, np.int64).reshape(-1, 2).T
        there = pa.array([name.encode() in found for found in self.blocks], pa.bool_())
        return pc.if_else(there, _slices(self.data, starts, ends), pa.scalar(None, pa.string()))


class Walk:
    """The walk over the fields of some messages; lens: fields per message; anchors: name -> (anchor tags, member tags)."""

    def __init__(self, tags: pa.StringArray, values: pa.StringArray, lens: np.ndarray, anchors: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] | None = None):
        self.first, n = np.cumsum(lens) - lens, len(tags)
        self.message = np.repeat(np.arange(len(lens)), lens)
        self.paths: list[tuple[str, ...]] = [()]
        self.problems: dict[int, str] = {}
        self.expected: dict[int, str | None] = {}
        self.unclosed = np.zeros(len(lens), np.int64)
        opens = pc.equal(tags, "16R").to_numpy(zero_copy_only=False)
        closes = pc.equal(tags, "16S").to_numpy(zero_copy_only=False)
        at = np.arange(n) if anchors else np.flatnonzero(opens | closes)
        known, own = {(): 0}, np.full(n + 1, -1, np.int64)
        starts = {tag: name for name, (own_tags, _) in reversed((anchors or {}).items()) for tag in own_tags}
        held: list[tuple[int, int]] = []

        def number(stack: tuple[str, ...]) -> int:
            if stack not in known:
                known[stack] = len(self.paths)
                self.paths.append(stack)
            return known[stack]

        if not anchors:
            self._brackets(at, opens, values, own, number)
            at = at[:0]
        message, stack, counts, group = -1, (), {}, None
        rows = zip(at.tolist(), self.message[at].tolist(), (tags.to_pylist() if anchors else [None] * len(at)), values.take(pa.array(at)).to_pylist(), opens[at].tolist(), closes[at].tolist(), strict=True)
        for i, m, tag, name, opening, closing in rows:
            if m != message:
                message, stack, counts, group = m, (), {}, None
            if closing:
                if stack and stack[-1].rpartition("[")[0] == name:
                    stack = stack[:-1]
                else:
                    self.problems[i], self.expected[i] = "mismatched_end", stack[-1].rpartition("[")[0] if stack else None
            elif anchors and not stack:
                # At root an anchor begins a group, members stay in it, any other field ends it.
                if tag in starts:
                    k = counts[(), starts[tag]] = counts.get(((), starts[tag]), -1) + 1
                    group = starts[tag], k
                elif group and tag not in anchors[group[0]][1]:
                    group = None
                if group:
                    held.append((i, number((f"{group[0]}[{group[1]}]",))))
            if opening and len(stack) < MAX_DEPTH:
                k = counts[stack, name] = counts.get((stack, name), -1) + 1
                stack = (*stack, f"{name}[{k}]")
            elif opening:
                self.problems[i] = "depth"
            if opening or closing:
                own[i + 1] = self.unclosed[m] = number(stack)
        own[self.first[lens > 0]] = 0
        # The path of a row is the last that was set at or before it.
        self.path = own[np.maximum.accumulate(np.where(own[:n] >= 0, np.arange(n), 0))] if n else own[:0]
        for i, k in held:
            self.path[i] = k

    def _brackets(self, at: np.ndarray, opens: np.ndarray, values: pa.StringArray, own: np.ndarray, number: Callable[[tuple[str, ...]], int]) -> None:
        """The walk where only rows that open or close sequences count: messages whose rows of that kind are the same, one after
        another, are walked once."""
        names = values.take(pa.array(at)).dictionary_encode()
        code = names.indices.to_numpy() * 2 + opens[at]
        heads = np.flatnonzero(np.concatenate([[True], np.diff(self.message[at]) != 0]))[: len(at)].tolist()
        known: dict[bytes, tuple[list[int], list[tuple[int, str, str | None]]]] = {}
        spelled, states = names.dictionary.to_pylist(), []
        for a, b in zip(heads, [*heads, len(at)][1:], strict=True):
            key = code[a:b].tobytes()
            if key not in known:
                known[key] = self._walked(code[a:b].tolist(), spelled, number)
            ids, problems = known[key]
            states.append(ids)
            for i, problem, expected in problems:
                row = int(at[a + i])
                self.problems[row] = problem
                if problem == "mismatched_end":
                    self.expected[row] = expected
            self.unclosed[self.message[at[a]]] = ids[-1]
        if states:
            own[at + 1] = np.concatenate(states)

    def _walked(self, codes: list[int], spelled: list[str], number: Callable[[tuple[str, ...]], int]) -> tuple[np.ndarray, list[tuple[int, str, str | None]]]:
        """(the path after each row, the rows with a problem) of one message's rows that open (odd) or close sequences."""
        stack, counts, ids, problems = (), {}, [], []
        for i, code in enumerate(codes):
            name = spelled[code >> 1]
            if not code & 1:
                if stack and stack[-1].rpartition("[")[0] == name:
                    stack = stack[:-1]
                else:
                    problems.append((i, "mismatched_end", stack[-1].rpartition("[")[0] if stack else None))
            elif len(stack) < MAX_DEPTH:
                k = counts[stack, name] = counts.get((stack, name), -1) + 1
                stack = (*stack, f"{name}[{k}]")
            else:
                problems.append((i, "depth", None))
            ids.append(number(stack))
        return np.array(ids, np.int64), problems

    def occurrences(self, *keys: pa.Array) -> np.ndarray:
        """How many rows before each have its message, path and keys, closing rows that match nothing apart."""
        code = self.message * len(self.paths) + self.path
        for key in keys:
            found = pc.fill_null(key, "").dictionary_encode()
            code = code * (len(found.dictionary) + 1) + found.indices.to_numpy()
        lost = [i for i, p in self.problems.items() if p == "mismatched_end"]
        code[lost] = -1 - np.arange(len(lost))
        order = np.argsort(code, kind="stable")
        starts = np.concatenate([[True], np.diff(code[order]) != 0])[: len(order)]
        out = np.empty(len(order), np.int64)
        out[order] = np.arange(len(order)) - np.flatnonzero(starts)[np.cumsum(starts) - 1] if len(order) else 0
        return out

    def defects(self, values: pa.StringArray) -> Iterator[tuple]:
        for i, p in self.problems.items():
            depth = p == "depth"
            yield int(self.message[i]), "limit_sequence_depth" if depth else "mismatched_sequence_end", None, str(MAX_DEPTH + 1) if depth else values[i].as_py(), self.expected.get(i)
        for m, k in enumerate(self.unclosed.tolist()):
            for name in reversed(self.paths[k]):
                yield m, "unclosed_sequence", None, name.rpartition("[")[0], None


def parts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each has about PART_BYTES of text, or one row."""
    for batch in batches:
        ends, at = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_BYTES, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


FIELDS = "message_id string, message_type string, field_seq long, tag string, value string"
WALKED = f"{FIELDS}, problem string, qualifier string, seq_index string, seq_path string, occurrence long"
FULL = f"{WALKED}, path array<string>, unclosed array<string>"
DEFECTS = "message_id string, kind string, byte_offset long, detail string, expected string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def cut_fields(limits: bool):
    """Rows message_id, message_type, body -> FIELDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2):
            c = Cut(part.column(2), limits)
            message = pa.array(c.message)
            yield pa.RecordBatch.from_arrays([part.column(0).take(message), part.column(1).take(message), pa.array(c.seq), c.tags, c.values], _names(FIELDS))

    return run


def walk_fields(full: bool, anchors: dict | None):
    """Rows message_id, message_type, body -> WALKED, or FULL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2):
            c = Cut(part.column(2))
            w = Walk(c.tags, c.values, c.lens, anchors)
            qualifier = pc.if_else(pc.match_substring_regex(c.values, "^:[A-Za-z0-9]{4}//"), pc.utf8_slice_codeunits(c.values, 1, 5), pa.scalar(None, pa.string()))
            problem = np.full(len(c.tags), None, object)
            for i, p in w.problems.items():
                problem[i] = p
            path, message = pa.array(w.path), pa.array(c.message)
            index = pa.array(["/".join(p) or "$" for p in w.paths]).take(path)
            plain = pa.array(["/".join(x.rpartition("[")[0] for x in p) or "$" for p in w.paths]).take(path)
            cols = [part.column(0).take(message), part.column(1).take(message), pa.array(c.seq), c.tags, c.values, pa.array(problem, pa.string()), qualifier, index, plain, pa.array(w.occurrences(c.tags, qualifier))]
            if full:
                lists = pa.array([list(p) for p in w.paths], pa.list_(pa.string()))
                left, some = np.zeros(len(c.tags), np.int64), np.flatnonzero(c.lens > 0)
                left[w.first[some] + c.lens[some] - 1] = w.unclosed[some]
                cols += [lists.take(path), lists.take(pa.array(left))]
            yield pa.RecordBatch.from_arrays(cols, _names(FULL if full else WALKED))

    return run


def find_defects(anchors: dict | None = None):
    """Rows message_id, message_type, body -> DEFECTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 2):
            c = Cut(part.column(2))
            rows = c.defects + list(Walk(c.tags, c.values, c.lens, anchors).defects(c.values))
            message, kind, offset, detail, expected = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(message, pa.int64())), pa.array(kind, pa.string()), pa.array(offset, pa.int64()), pa.array(detail, pa.string()), pa.array(expected, pa.string())], _names(DEFECTS))

    return run


def add_blocks(column: int):
    """Rows with the message text in a column -> the same with block1 to block5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, column):
            c = Cut(part.column(column), limits=False)
            yield pa.RecordBatch.from_arrays([*part.columns, *map(c.block, BLOCKS)], [*part.schema.names, *(f"block{b}" for b in BLOCKS)])

    return run
