"""Known answers and awkward messages."""

import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewire.functions import text
from tidewire.operators import cash, entities, ledger, parse, penalty, rules, structure
from tidewire.sources import inbox
from tidewire.streaming import landing


def messages(spark, *bodies, kind="MT537"):
    return spark.createDataFrame([(f"m{i}", kind, b) for i, b in enumerate(bodies)], "message_id string, message_type string, body string")


def fin(block4):
    return "{1:F01AAAABBCCAXXX0000000000}{2:I537AAAABBCCXXXXN}{4:\n" + block4 + "\n-}"


def test_statement_lines(spark):
    body = fin(":20:S\n:25:A\n:60F:C260501EUR100000,\n:61:2605010501C25000,NTRFREF//BANK\nmore\n:61:260502RC1000,5NCHGX\n:86:why\n:61:bad\n:62F:C260503EUR123999,5")
    heads, rows = cash.cash_star(messages(spark, body, kind="MT940"))
    got = [tuple(r) for r in rows.orderBy("row_seq").select("value_date", "direction", "signed_amount", "transaction_type", "customer_ref", "bank_ref", "info").collect()]
    assert got == [("2026-05-01", "credit", 25000.0, "TRF", "REF", "BANK", "more"), ("2026-05-02", "reversal_credit", -1000.5, "CHG", "X", None, "why")]
    assert cash.verdicts(heads, rows).first()["reconciles"]


def test_limits_are_recorded_and_cash_is_whole(spark):
    lines = [":61:2605010501C1,NTRFREF\n:86:x"] * (structure.MAX_FIELDS // 2)
    hot = fin("\n".join([":20:S", ":25:A", ":60F:C260501EUR0,", *lines, f":62F:C260503EUR{len(lines)},"]))
    heavy = fin(":20:S\n:25:A\n:60F:C260501EUR0,\n:61:2605010501C1,NTRFREF\n:86:" + "x" * structure.MAX_BLOCK_BYTES + "\n:62F:C260503EUR1,")
    huge = heavy.replace("\n:62F", "x" * (structure.MAX_MESSAGE_BYTES - structure.MAX_BLOCK_BYTES) + "\n:62F")
    m = messages(spark, hot, heavy, huge, "{1:F01{2:I537}", "{1:F01}{2:I537}{3:{108:x}}{4:\n:20:{a:\n-}{5:{CHK:1}}", "{1:a}{4:\n{5:b", kind="MT940")
    found = sorted((r.message_id, r.kind, r.detail) for r in structure.diagnostics(m).collect())
    size = len(heavy) - heavy.index("{4:")
    assert found == [("m0", "limit_fields", "10001"), ("m1", "limit_block_bytes", str(size)), ("m2", "limit_message_bytes", str(len(huge))), ("m3", "unclosed_block", ""), ("m5", "unclosed_text_block", "")]
    kept = {r.message_id: r["count"] for r in structure.fields(m).groupBy("message_id").count().collect()}
    assert kept == {"m0": structure.MAX_FIELDS, "m4": 1}
    heads, rows = cash.cash_star(m.where("message_id in ('m0', 'm1', 'm2')"))
    got = {r.message_id: (r.net, r.reconciles) for r in cash.verdicts(heads, rows).collect()}
    assert got == {"m0": (float(len(lines)), True), "m1": (1.0, True), "m2": (1.0, True)}


def test_paths_and_defects(spark):
    body = fin("lost\n:16R:A\n:16R:B\n:20C::SEME//X\n  two\n:16S:B\n:16R:B\n:16S:C\n:bad line\n:16S:B\n:16S:A\n:16R:A")
    rows = structure.field_rows(messages(spark, body, "", "no blocks", "{4:\n"))
    got = [(r.tag, r.seq_index) for r in rows.orderBy("field_seq").collect()]
    assert got == [("16R", "$"), ("16R", "A[0]"), ("20C", "A[0]/B[0]"), ("16S", "A[0]/B[0]"), ("16R", "A[0]"), ("16S", "A[0]/B[1]"), ("16S", "A[0]"), ("16R", "$")]
    kinds = sorted((r.message_id, r.kind) for r in structure.diagnostics(messages(spark, body, "{4:\n", "{x}")).collect())
    assert kinds == [("m0", "malformed_field_tag"), ("m0", "mismatched_sequence_end"), ("m0", "unclosed_sequence"), ("m1", "unclosed_text_block"), ("m2", "missing_block_separator")]


def _walk_by_hand(fields):
    """Rows (seq, tag, path, problem, occurrence) of one message, and what is left open."""
    stack, counts, seen, rows = [], {}, {}, []
    for i, (tag, value) in enumerate(fields):
        path, problem = "/".join(stack) or "$", None
        if tag == "16S":
            if stack and stack[-1].split("[")[0] == value:
                stack.pop()
            else:
                problem = "mismatched_end"
        elif tag == "16R" and len(stack) < structure.MAX_DEPTH:
            at = (path, value)
            counts[at] = counts.get(at, -1) + 1
            stack.append(f"{value}[{counts[at]}]")
        elif tag == "16R":
            problem = "depth"
        qual = value[1:5] if re.match(":[A-Za-z0-9]{4}//", value) else None
        n = seen.get((path, tag, qual), 0)
        if problem != "mismatched_end":
            seen[path, tag, qual] = n + 1
        rows.append((i, tag, path, problem, None if problem == "mismatched_end" else n, qual))
    return rows, stack


def test_walk_by_hand(monkeypatch):
    r = random.Random(1)
    monkeypatch.setattr(parse, "PART_BYTES", 500)
    given = []
    for _ in range(60):
        deep = r.random() < 0.2
        given.append([r.choice([("16R", "A"), ("16R", "B"), *([] if deep else [("16S", "A"), ("16S", "B")]), ("70E", "x"), ("20C", ":SEME//1"), ("20C", ":RELA//2")]) for _ in range(r.choice([0, 3, 30, 120]))])
    bodies = ["{4:" + "".join(f"\n:{t}:{v}" for t, v in m) + "\n-}" for m in given]
    batch = pa.RecordBatch.from_arrays([pa.array([f"m{i}" for i in range(60)]), pa.array(["MT"] * 60), pa.array(bodies)], ["message_id", "message_type", "body"])
    got = {}
    for part in parse.walk_fields(True, None)(iter([batch.slice(0, 25), batch.slice(25)])):
        for x in part.to_pylist():
            got.setdefault(x["message_id"], []).append(x)
    for i, m in enumerate(given):
        rows, left = _walk_by_hand(m)
        mine = got.get(f"m{i}", [])
        assert [(x["field_seq"], x["tag"], x["seq_index"], x["problem"], None if x["problem"] == "mismatched_end" else x["occurrence"], x["qualifier"]) for x in mine] == rows
        assert [("/".join(x["path"]) or "$", re.sub(r"\[\d+\]", "", x["seq_index"])) for x in mine] == [(x["seq_index"], x["seq_path"]) for x in mine]
        assert not mine or (mine[-1]["unclosed"] == left and not any(x["unclosed"] for x in mine[:-1]))


def test_split_at_any_number_of_separators(spark):
    one, two = "{1:A}{2:I537}{4:\n-}", "{1:B}{2:I540}"
    text = f"{one}{'$ \r\n' * 500}{two}\0\2x}}\0\3\0{{1:C}}}} {{1:"
    df = spark.createDataFrame([("s", "f", bytearray(text.encode()))], "source_id string, name string, content binary")
    got = structure.messages_of_files(df).orderBy("fragment").collect()
    assert [(x.body, x.kept) for x in got] == [(one, True), (f"{two}\0\2x}}\0\3\0{{1:C}}}}", True), ("{1:", False)]
    assert [text.encode()[x.byte_offset :].startswith(x.body.encode()) for x in got] == [True] * 3


trees = st.recursive(st.lists(st.just("f"), max_size=2), lambda t: st.lists(st.tuples(st.sampled_from("AB"), t), max_size=3), max_leaves=8)


@settings(max_examples=8, deadline=None)
@given(trees)
def test_nested_trees(spark, tree):
    lines, want = [], []

    def walk(node, path):
        seen = {}
        for child in node:
            if child == "f":
                lines.append(":70E:x")
                want.append("/".join(path) or "$")
            else:
                name, inner = child
                n = seen[name] = seen.get(name, -1) + 1
                lines.append(f":16R:{name}")
                walk(inner, [*path, f"{name}[{n}]"])
                lines.append(f":16S:{name}")

    walk(tree, [])
    m = messages(spark, fin("\n".join(lines)))
    got = [r.seq_index for r in structure.field_rows(m).where("tag = '70E'").orderBy("field_seq").collect()]
    assert got == want and structure.diagnostics(m).count() == 0


def _nearness(at, fact):
    """How near a fact is to an event, None where it doesn't count: one more than the leading parts they share in a branch."""
    if at is None:
        return 0
    if fact == "$":
        return 0
    if at == "$":
        return None
    a, b = at.split("/"), fact.split("/")
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n + 1
    if len(a) == len(b) > 1 and a[:-1] == b[:-1]:
        return len(a)
    return 1 if a[0] != b[0] and a[0].split("[")[1] == b[0].split("[")[1] else None


@pytest.mark.parametrize("seed", range(4))
def test_nearest_facts(spark, seed):
    """Lookups by keys against comparing every event with every fact of its message."""
    r = random.Random(seed)
    part = lambda: f"{r.choice('ABC')}[{r.randrange(2)}]"
    path = lambda: r.choice(["$", part(), f"{part()}/{part()}", f"{part()}/{part()}/{part()}"])
    kinds = [("x_transaction", "amount"), ("x", "amount"), ("settlement_quantity", "quantity"), ("x", "quantity"), ("x", "safekeeping"), ("settlement_account", "an_account"), ("a_party", "account"), ("x_status", "status_code"), ("mt537_statement", "sender_reference"), ("y", "other")]
    values, dates = [], []
    for m in range(6):
        for i in range(r.randrange(4)):
            values.append((f"m{m}", "MT537", "x", "instrument", path(), f"ISIN US000000000{i}", "", 10 * i))
        for i in range(r.randrange(25)):
            entity, column = r.choice(kinds)
            values.append((f"m{m}", "MT537", entity, column, path(), str(r.randrange(1000)), f"EUR{i}", 1000 + r.randrange(1000)))
        dates += [(f"m{m}", path(), f"202605{r.randrange(10, 31)}", 3000 + i) for i in range(r.randrange(4))]
    v = spark.createDataFrame(values, "message_id string, message_type string, entity string, column string, seq_index string, value string, raw string, row_ord long")
    rows = spark.createDataFrame([(m, "98A", "SETT", p, d, n) for m, p, d, n in dates], "message_id string, tag string, qualifier string, seq_index string, value string, field_seq long")
    m = spark.createDataFrame([(f"m{i}", "MT537") for i in range(6)], "message_id string, message_type string")
    tests = {
        "amount": [(lambda e, c: "transaction" in e and c == "amount", 2), (lambda e, c: c == "amount", 1)], "quantity": [(lambda e, c: e == "settlement_quantity" and c == "quantity", 2), (lambda e, c: c == "quantity", 1)],
        "safekeeping_account": [(lambda e, c: "safekeep" in c, 3), (lambda e, c: e == "settlement_account" and "account" in c, 2), (lambda e, c: c == "account" and ("account" in e or "party" in e), 1)], "status": [(lambda e, c: c == "status_code" and "status" in e, 2)],
    }
    want = []
    for i in range(6):
        own = sorted((x for x in values if x[0] == f"m{i}" and x[3] == "instrument"), key=lambda x: x[7])
        for k, x in enumerate(own or [(f"m{i}", "", "", "", None, "", "", 0)]):
            out = [f"m{i}", k]
            for choices in tests.values():
                fit = [(next(p for f, p in choices if f(y[2], y[3])), n, -y[7], y[5]) for y in values if y[0] == f"m{i}" and any(f(y[2], y[3]) for f, _ in choices) and (n := _nearness(x[4], y[4])) is not None]
                out.append(max(fit)[3] if fit else None)
            days = [(n, -seq, d) for mm, p, d, seq in dates if mm == f"m{i}" and (n := _nearness(x[4], p)) is not None and (x[4] is None or n > 0)]
            sent = [(y[7], y[5]) for y in values if y[0] == f"m{i}" and y[3] == "sender_reference"]
            want.append((*out, f"2026-05-{max(days)[2][-2:]}" if days else None, min(sent)[1] if sent else None))
    got = entities.security_events(v, rows, m).select("message_id", "row_seq", F.col("amount").cast("int").cast("string"), F.col("quantity").cast("int").cast("string"), "safekeeping_account", "status", "settlement_date", "transaction_ref").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_penalties(spark):
    rows = [("swift", "m", "R1", "GB0000000001", "GILT 4%", "BANK", None, 10.0, 12345.67, "PEND", "2026-05-12"), ("swift", "m", None, "GB0000000002", "ACME ORD", "BANK", "EUR", 1.0, 12345.67, "penf ", None), ("swift", "m", None, None, "x", None, None, 1.0, 5.0, "PEND", None)]
    events = spark.createDataFrame(rows, "source string, message_id string, transaction_ref string, isin string, instrument_desc string, party_bic string, currency string, quantity double, amount double, status string, settlement_date string")
    got = {r.transaction_ref: (r.instrument_type, r.currency, r.computed_amount) for r in penalty.accruals(events, penalty.rates(spark)).collect()}
    assert got == {"R1": ("sovereign_bond", "EUR", -0.12), "m": ("liquid_share", "EUR", -1.23)}


def test_sources(spark):
    files = spark.createDataFrame([("p.csv", "Quantity,ISIN,extra\n5,us0000000001,x\nx,BAD,y\n\n")], "name string, text string")
    assert [(r.isin, r.quantity) for r in inbox.positions(files).orderBy("message_id").collect()] == [("US0000000001", 5.0), (None, None)]
    red = spark.createDataFrame([("to AAAABBCCXXX pay 1234567 not 12345 or AAAABB",)], "t string").select(text.redacted(F.col("t"))).first()[0]
    assert red == "to [REDACTED_BIC] pay [REDACTED_ACCOUNT] not 12345 or AAAABB"
    runs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "job_id string, updated_at int, status string")
    assert ledger.upserted(runs, runs.limit(0)).first().status == "y"
    assert rules.catalog_issues(rules.rules(spark), rules.sequences(spark), rules.types(spark)).count() == 0


def test_landing_stream(spark, tmp_path):
    box, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    box.mkdir()
    (box / "a.fin").write_bytes("$\r\n".join(fin(f":20:{i}\n:25:x") for i in range(5)).encode())
    landing.stream(spark, str(box), table, mark).awaitTermination()
    (box / "b.fin").write_bytes((box / "a.fin").read_bytes())
    (box / "c.fin").write_text(fin(":20:new\n:25:x"))
    landing.stream(spark, str(box), table, mark).awaitTermination()
    got = spark.read.parquet(f"{table}/raw")
    assert got.count() == got.select("message_id").distinct().count() == 6
