"""Blocks, fields, groups and diagnostics against a plain parser that reads byte by byte."""

import random

import pytest

from tidewire.operators import parse, structure
from tests.test_operators import fin, messages


def by_hand(text):
    """(contents of blocks by id, fields, defects) of one message's bytes."""
    blocks, defects, at = {}, [], 0
    while at < len(text):
        if text[at : at + 1] != b"{":
            at += 1
            continue
        head = text[at + 1 :].split(b":")[0]
        if at + 3 > len(text):
            defects.append(("unclosed_block", at, ""))
            break
        if b":" not in text[at:] or b"}" in head:
            defects.append(("missing_block_separator", at, ""))
            break
        i, depth = at + len(head) + 2, 1
        start = i
        while i < len(text):
            if head == b"4":
                if text[i : i + 2] == b"-}":
                    break
            else:
                depth += {b"{": 1, b"}": -1}.get(text[i : i + 1], 0)
                if not depth:
                    break
            i += 1
        else:
            defects.append(("unclosed_text_block" if head == b"4" else "unclosed_block", at, ""))
            break
        # A brace in the id counts for the depth too.
        if head != b"4" and b"{" in head:
            depth, i = 0, at
            while i < len(text):
                depth += {b"{": 1, b"}": -1}.get(text[i : i + 1], 0)
                if not depth:
                    break
                i += 1
            else:
                defects.append(("unclosed_block", at, ""))
                break
        blocks.setdefault(head, (start, text[start:i]))
        at = i + (2 if head == b"4" else 1)
    fields = []
    if b"4" in blocks:
        base, block = blocks[b"4"]
        place = 0
        for line in block.split(b"\n"):
            parts = line[1:].split(b":", 1)
            tag = parts[0]
            if line.startswith(b":") and len(parts) == 2 and 2 <= len(tag) <= 4 and tag.isalnum() and tag.isascii():
                fields.append([tag.decode(), parts[1]])
            else:
                if line.startswith(b":"):
                    defects.append(("malformed_field_tag", base + place, ""))
                if fields:
                    fields[-1][1] += b"\n" + line
            place += len(line) + 1
    return {k: v.decode() for k, (_, v) in blocks.items()}, [(t, v.decode().strip(" \t\n\f\r")) for t, v in fields], defects


def bodies(seed):
    r = random.Random(seed)
    bits = ["{", "}", "{1:", "{4:", "{3:{108:{A:{B:x}}}}", "-}", "\n:20:é", "\r\n:16R:A", "\n:16S:A", "\n:bad", ":", "\n", "x", " ", "{5:{CHK:1}{2:", "\n:ABCDE:v", "\n:61:1", "\n:ß:x", "{2:I540}", "\n::"]
    return ["".join(r.choice(bits) for _ in range(r.randrange(14))) for _ in range(400)] + ["prefix{1ABC}", "prefix{1:ABC", "prefix{4:\n:20C::SEME//ABC123\n", "prefix{1:F01}{4:\n:20C::SEME//ABC123\n:BROKEN\n-}", "{", "{4:-}", "{4:", "é{3:{a:{b:{c:}}}}{4:\n:20:a\nb\n-}{5:{}"]


def test_blocks_fields_and_offsets(spark, monkeypatch):
    texts = bodies(1)
    monkeypatch.setattr(parse, "PART_BYTES", 200)
    m = messages(spark, *texts, None)
    want = {f"m{i}": by_hand(t.encode()) for i, t in enumerate([*texts, ""])}
    for r in structure.blocks(m.withColumnRenamed("message_type", "block1")).collect():
        assert {str(i): r[f"block{i}"] for i in range(1, 6) if r[f"block{i}"] is not None} == {k.decode(): v for k, v in want[r.message_id][0].items() if k in b"12345" and len(k) == 1}
    rows = {}
    for r in structure.fields(m).orderBy("message_id", "field_seq").collect():
        rows.setdefault(r.message_id, []).append((r.tag, r.value))
    assert rows == {k: v for k, (_, v, _) in want.items() if v}
    got = {}
    for r in structure.diagnostics(m).collect():
        if r.byte_offset is not None:
            got.setdefault(r.message_id, []).append((r.kind, r.byte_offset, r.detail))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, (_, _, v) in want.items() if v}
    assert structure.diagnostics(m.limit(0)).count() == structure.blocks(m.limit(0)).count() == structure.field_rows(m.limit(0)).count() == 0


def test_defects_of_sequences(spark):
    deep = "\n".join(f":16R:S{i}" for i in range(parse.MAX_DEPTH + 1))
    got = [(r.message_id, r.kind, r.detail, r.expected) for r in structure.diagnostics(messages(spark, fin(":16S:X\n:16R:A\n:16S:B\n:16R:B"), fin(deep))).collect()]
    ends = [("m0", "mismatched_sequence_end", "B", "A"), ("m0", "mismatched_sequence_end", "X", None), ("m0", "unclosed_sequence", "A", None), ("m0", "unclosed_sequence", "B", None)]
    want = ends + [("m1", "limit_sequence_depth", str(parse.MAX_DEPTH + 1), None)] + [("m1", "unclosed_sequence", f"S{i}", None) for i in range(parse.MAX_DEPTH)]
    assert sorted(got, key=str) == sorted(want, key=str)


def groups_by_hand(fields, anchors):
    stack, counts, group, out = [], {}, None, []
    for tag, value in fields:
        if tag == "16S":
            path = "/".join(stack) or "$"
            if stack and stack[-1].split("[")[0] == value:
                stack.pop()
                out.append((tag, path))
            continue
        path = "/".join(stack) or "$"
        if not stack:
            own = next((n for n, (tags, _) in anchors.items() if tag in tags), None)
            if own:
                counts[own] = counts.get(own, -1) + 1
                group = own, counts[own]
            elif group and tag not in anchors[group[0]][1]:
                group = None
            if group:
                path = f"{group[0]}[{group[1]}]"
        out.append((tag, path))
        if tag == "16R":
            at = ("/".join(stack), value) if stack else value
            counts[at] = counts.get(at, -1) + 1
            stack.append(f"{value}[{counts[at]}]")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_anchored_groups(spark, seed):
    """Two groups, one with an alternative anchor, beside brackets, one of which has a group's name."""
    anchors = {"E": (("61", "61X"), ("86",)), "B": (("60F",), ("86", "90D"))}
    r, given = random.Random(seed), []
    for _ in range(40):
        given.append([r.choice([("61", "a"), ("61X", "b"), ("86", "c"), ("60F", "d"), ("90D", "e"), ("20", "f"), ("16R", "E"), ("16S", "E"), ("16R", "A")]) for _ in range(r.randrange(30))])
    m = messages(spark, *(fin("\n".join(f":{t}:{v}" for t, v in fields)) for fields in given))
    df = structure.field_rows(m, anchors)
    got = {}
    for x in df.orderBy("message_id", "field_seq").collect():
        got.setdefault(x.message_id, []).append((x.tag, x.seq_index))
    assert got == {f"m{i}": w for i, fields in enumerate(given) if (w := groups_by_hand(fields, anchors))}
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
