"""Evolving tables, kept ledgers, metrics and render errors on small inputs."""

import pytest

from tidewire.operators import books, ledger, penalty, render, rules
from tidewire.sources import adapters, evolve

ROWS = "job_id string, at int, status string"


def test_ledger_versions(spark, tmp_path):
    folder = str(tmp_path)
    now = lambda: sorted(map(tuple, ledger.current(spark, folder, ROWS, "job_id", ("at",)).collect()))
    put = lambda n, *rows: ledger.append(spark.createDataFrame(rows, ROWS), folder, n)
    assert now() == []
    put(0, ("a", 1, "x"), ("b", 1, "x"))
    put(1, ("a", 3, "y"))
    assert now() == [("a", 3, "y"), ("b", 1, "x")]
    begun = ledger.current(spark, folder, ROWS, "job_id", ("at",))
    assert ledger.compact(spark, folder, ROWS, "job_id", ("at",)) == 1
    put(2, ("a", 2, "late"), ("c", 1, "z"))
    assert sorted(map(tuple, begun.collect())) == [("a", 3, "y"), ("b", 1, "x")]
    put(2, ("a", 4, "w"), ("c", 1, "z"))
    assert now() == [("a", 4, "w"), ("b", 1, "x"), ("c", 1, "z")] and ledger.audit(spark, folder, ROWS).count() == 5
    assert ledger.compact(spark, folder, ROWS, "job_id", ("at",)) == 2 and now() == [("a", 4, "w"), ("b", 1, "x"), ("c", 1, "z")]


def test_evolved_table(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert evolve.append(spark.createDataFrame([(1, 2, 1.5)], "k int, n int, d double"), folder) == []
    assert evolve.append(spark.createDataFrame([(2, 3, 2.5)], "k int, n int, d double"), folder) == []
    found = evolve.append(spark.createDataFrame([(3, 4.0, "x", "new")], "k long, n double, d string, c string"), folder)
    assert found == [("k", "changed", "int", "bigint"), ("n", "changed", "int", "double"), ("d", "changed", "double", "string"), ("c", "added", None, "string")]
    df = evolve.read(spark, folder)
    assert df.schema.simpleString() == "struct<k:bigint,n:double,d:string,c:string>"
    assert sorted(map(tuple, df.collect())) == [(1, 2.0, "1.5", None), (2, 3.0, "2.5", None), (3, 4.0, "x", "new")]
    assert evolve.read(spark, folder, df.select("c", "k").schema).count() == 3
    assert evolve.read(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_metrics_in_the_writing_pass(spark, tmp_path):
    df = spark.createDataFrame([("A", 5), ("A", 50), (None, 7), ("Z", None)], "kind string, size int")
    got = {(r.metric, r.label): r.n for r in books.metered(df, "kind", "size", ["A", "B"], [5, 10], lambda d: d.write.parquet(str(tmp_path / "m"))).collect()}
    assert got == {("rows", ""): 4, ("bytes", ""): 62, ("messages", "A"): 2, ("messages", "B"): 0, ("messages", "other"): 2, ("size_at_most", "5"): 1, ("size_at_most", "10"): 2}
    assert spark.read.parquet(str(tmp_path / "m")).count() == 4


def test_open_options_are_not_rendered(spark):
    """A message with a field whose option is open is left out; the other is rendered, and the error names the rule."""
    rule = lambda n, options, option, column: ("MT1", n, "$", "20", options, None, column, "text", None, False, None, None, "e", column, option)
    catalog = rules.Catalog(rules.TYPES, [rule(1, ["C"], None, "a"), rule(2, ["A", "B"], None, "b"), rule(3, ["A"], "AB", "c")], [])
    values = spark.createDataFrame([("e", m, "MT1", "$", c, "v", "v") for m, c in (("m1", "a"), ("m2", "a"), ("m2", "b"), ("m3", "c"))], "entity string, message_id string, message_type string, seq_index string, column string, value string, raw string")
    rule_rows = rules.rules(spark, catalog)
    assert [(r.message_id, r.body.split("{4:")[1]) for r in render.messages_from(values, rule_rows).collect()] == [("m1", "\n:20C:v\n-}")]
    got = render.errors(values, values.select("message_id", "message_type"), rule_rows, rules.sequences(spark, catalog), rules.types(spark, catalog))
    assert sorted(map(tuple, got.collect())) == [("m2", "missing_render_option", "b"), ("m3", "invalid_render_option", "c")]
    assert render.errors(values.limit(0), values.select("message_id", "message_type").limit(0), rule_rows, rules.sequences(spark, catalog), rules.types(spark, catalog)).count() == 0


def test_run_fails_without_rules(spark):
    catalog = rules.rules(spark)
    odd = spark.createDataFrame([("m", "MT999")], "message_id string, message_type string")
    with pytest.raises(ValueError, match="MT999"):
        rules.without_rules(odd, catalog, fail=True)
    assert rules.without_rules(odd.where("false"), catalog, fail=True).count() == 0


def test_dispositions_of_their_period(spark):
    amounts = "0.0D as computed_amount, -2.0D as reported_amount, -2.0D as diff, 'missing_computed' as status"
    lines = spark.sql(f"select 'k' as key, '2026-01' as period, {amounts} union all select 'k', '2026-02', {amounts}")
    none = spark.sql("select 'r' as transaction_ref, 'i' as isin, 'SEFP' as penalty_type, 1.0D as reference_amount, 1.0D as penalty_rate_bps where false")
    given = spark.createDataFrame([("2026-02", "k", "accepted")], "period string, key string, disposition string")
    got = {r.period: r.disposition for r in penalty.work_lines(lines, none, given).collect()}
    assert got == {"2026-01": "open", "2026-02": "accepted"}


def test_adapters(spark):
    """Every adapter of a kind gives the same columns; an unknown one is refused; another can be registered."""
    files = spark.createDataFrame([("p.csv", "isin,quantity\nUS0000000001,5")], "name string, text string")
    got = adapters.security_events("csv", files)
    assert got.columns == [c.split()[0] for c in adapters.EVENT.split(", ")] and got.first()["quantity"] == 5.0
    with pytest.raises(ValueError, match="no adapter odd; there are camt.053, swift"):
        adapters.cash_statements("odd", files)
    adapters.register_security("own", lambda df: df.selectExpr("name as message_id", "'7' as quantity", "'x' as extra"))
    try:
        assert [tuple(r)[1:6] for r in adapters.security_events("own", files).collect()] == [("p.csv", None, None, None, 7.0)]
    finally:
        del adapters._SECURITY["own"]
