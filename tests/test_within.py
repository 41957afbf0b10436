"""Values and events from one pass over messages, against field rows, joins and groups."""

import random

import pytest

from tidewire.operators import capture, entities, rules, structure

MESSAGES = "message_id string, message_type string, body string"
LINES = [
    *(f":16{x}:{n}" for n in ("GENL", "STAT", "TRAN", "LINK", "TRANSDET", "SETPRTY", "TRADDET", "SETDET", "AMT", "A/B") for x in "RS"), ":20C::SEME//O1", ":25D::IPRC//PEND", ":20C::RELA//L1", ":35B:ISIN US0000000001\nX  BOND\n y",
    ":35B:/x\n  ISIN  GB00000000AB  \r\nISIN US0000000009", ":35B:NOTHING", ":36B::SETT//UNIT/5,5", ":36b::SETT//FAMT/7", ":19A::PSTA//NUSD1,25", ":19A::SETT//GBP7,é", ":98A::SETT//20240203", ":98A::SETT//2024020", ":98C::SETT//20240203101010", ":98A::SETT//20240203\u0085", ":95P::DEAG//B1", ":95P::XXXX//B3", ":97A::SAFE//S9", ":95P::DEAG//",
]


def odd(seed):
    r = random.Random(seed)
    block = lambda: "\n".join(r.choice(LINES) for _ in range(r.randrange(60)))
    nested = lambda: "\n".join([":16R:STAT", r.choice(LINES), ":16R:TRAN", ":16R:TRANSDET", *(r.choice(LINES[20:]) for _ in range(6)), ":16S:TRANSDET", ":16S:TRAN", ":16S:STAT", ":16R:TRADDET", *(r.choice(LINES[20:]) for _ in range(4)), ":16S:TRADDET"])
    return [(f"m{i}", r.choice(["MT537", "MT536", "MT540", " mt537 ", "MT999", None]), None if i == 5 else "{4:\n" + r.choice([block, nested])() + r.choice(["\n-}", "\n-}", ""])) for i in range(300)]


def by_rows(spark, m):
    rows = structure.field_rows(m)
    return rows, entities.entity_values(rules.captured(rules.matched(rows, rules.rules(spark)), rules.compiled(spark)))


@pytest.mark.parametrize("seed", range(2))
def test_values_and_events_without_a_shuffle(spark, seed):
    m = spark.createDataFrame(odd(seed), MESSAGES)
    rows, values = by_rows(spark, m)
    got = entities.values_of(m)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, values.select(*got.columns).collect())))
    events = entities.events_of(m)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (got, events)]
    assert not any("Exchange" in p or "FileScan" in p for p in plans)
    want = entities.security_events(values, rows, m)
    assert sorted(map(repr, map(tuple, events.collect()))) == sorted(map(repr, map(tuple, want.collect())))


def test_values_of_some_entities(spark):
    m = spark.createDataFrame(odd(3), MESSAGES)
    names = ("mt537_transaction", "settlement_quantity")
    want = [repr(tuple(r)) for r in entities.values_of(m).collect() if r.entity in names]
    assert sorted(repr(tuple(r)) for r in entities.values_of(m, entities=names).collect()) == sorted(want) and want


def test_patterns_beyond_what_re2_repeats():
    import pyarrow as pa

    steps = lambda n: [("literal", ":é_", None, None), ("capture", "value", "text", n)]
    texts = pa.array([":é_" + "x\n" * 600, ":é_" + "y" * 3, ":é_yyy\u2028", "no", None])
    assert capture.fitting(texts, steps(1200)).to_pylist() == ["x\n" * 600, None, None, None, None]
    assert capture.fitting(texts, steps(3)).to_pylist() == [None, "yyy", "yyy", None, None]


def test_slices_of_a_batch_take_their_own_bytes():
    import pyarrow as pa

    from tidewire.operators.parse import Cut

    bodies = pa.array([f"{{4:\n:20:A{i}\n-}}" for i in range(5)])
    cut = Cut(bodies.slice(3, 2))
    assert cut.values.to_pylist() == ["A3", "A4"] and len(cut.text) == 2 * len(bodies[0].as_py())


def test_entity_table_and_rendering_without_windows(spark):
    """An entity's table is pivoted in the pass, and lines are shuffled once on their way back to text."""
    from tidewire.operators import render

    m = spark.createDataFrame(odd(4), MESSAGES)
    rule_rows = rules.rules(spark)
    _, values = by_rows(spark, m)
    layout = rules.layout(rule_rows).collect()
    for name in ("mt537_transaction", "settlement_party"):
        table, want = entities.table_of(m, layout, name), entities.entity_table(values, layout, name)
        assert table.schema.names == want.schema.names and "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(repr, map(tuple, table.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    texts = render.messages_from(values, rule_rows)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("MapInArrow") == 2
    from_pass = render.messages_from(entities.values_of(m), rule_rows)
    assert sorted(map(tuple, from_pass.collect())) == sorted(map(tuple, texts.collect()))


def test_rendered_order(spark):
    """Lines come by their paths' first rules and occurrences, those of an enclosing sequence where their own rule puts them."""
    from tidewire.operators import render

    lines = [("m", "MT537", "STAT[10]/TRAN[0]", 6, ":d"), ("m", "MT537", "STAT[2]", 4, ":b"), ("m", "MT537", "GENL[0]", 1, ":a"), ("m", "MT537", "STAT[2]/TRAN[0]/LINK[0]", 5, ":c"), ("n", "MT537", "GENL[0]", 1, None)]
    got = render.block4(spark.createDataFrame(lines, "message_id string, message_type string, seq_index string, rule_ord int, line string"), rules.rules(spark)).collect()
    assert [(r.message_id, r.text.split("\n")) for r in got] == [("m", [":16R:GENL", ":a", ":16S:GENL", ":16R:STAT", ":b", ":16R:TRAN", ":16R:LINK", ":c", ":16S:LINK", ":16S:TRAN", ":16S:STAT", ":16R:STAT", ":16R:TRAN", ":d", ":16S:TRAN", ":16S:STAT"])]
