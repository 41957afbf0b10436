"""The driver contract, and queries against DuckDB at the smallest size."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry

DATA = Path("/root/testdata/sf0.001")
FAST = ("a1_net_movement", "a4_cash_pnl", "s16_mt940", "s7_split_fin", "f1_blocks", "f2_fields", "f3_paths", "f4_anchored", "f13_diagnostics", "r7_failures", "v1_missing_required", "v3_sequences", "v7_catalog", "s5_detect_format", "s10_csv_positions", "s13_camt", "pk_window", "l1_ledger", "p2_landing", "n7_render", "s2_prefix_scan", "f6_issuer", "p1_stream", "p4_first_per_key", "k9_ledger", "a14_metrics", "a12_report", "e16_snapshot")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{DATA / name}')")
    return con


def rows(records, columns):
    spell = lambda v: "" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(spell(r[i]) for i in order) for r in records)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", FAST)
def test_against_duckdb(spark, duck, name):
    got = entry.queries()[name](spark, str(DATA))
    want = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), columns)


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables aren't here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
