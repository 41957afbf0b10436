"""The reader of splits against the split of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators import structure
from tidewire.sources import inbox, reader


def some_file(seed):
    r = random.Random(seed)
    one = lambda i: "{1:F01X}{2:I940X}{4:\n:20:" + str(i) + "\n:86:" + r.choice(["été", "a{1:b", "x" * r.randrange(90), "}{1:F01", "ends}\n{1:"]) + "\n-}"
    return "".join(one(i) + r.choice(["", "$", "\r\n", "\x01 $\n\n", "}", "lost", "{1:F21}{4:{177:1}}"]) for i in range(r.randrange(1, 40)))


@pytest.mark.parametrize("size", [7, 64, 300, 100_000])
def test_read_messages(spark, tmp_path, size):
    texts = {f"f{i}.fin": some_file(i) for i in range(12)} | {"empty.fin": "", "none.fin": "no message", "lead.fin": "junk{1:a}{2:b}\n{1:c}", "skip.txt": "{1:x}"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    files = spark.createDataFrame([("s", n, t.encode()) for n, t in texts.items() if n.endswith(".fin")], "source_id string, name string, content binary")
    want = structure.messages_of_files(files).select("name", "byte_offset", "body", "kept")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = reader.read_messages(spark, str(tmp_path), ".fin").select(F.element_at(F.split("path", "/"), -1).alias("name"), "byte_offset", "body", "kept").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))


def test_statement_ranges(spark):
    text = '<?xml version="1.0"?><!-- é <Stmt>no</Stmt> --><n:D xmlns:n="u"><n:Stmt a="1"><x/>é</n:Stmt><n:Stmt/> <n:Stmts>s</n:Stmts><![CDATA[<n:Stmt>]]><n:Stmt >2</n:Stmt ></n:D>'
    df = spark.createDataFrame([("a", text), ("bad", "<D><Stmt>x</Stmt>"), ("none", "<D/>"), ("empty", ""), ("null", None)], "name string, text string")
    got = sorted(map(tuple, inbox.camt_fragments(df).collect()))
    assert [r[3] for r in got] == ['<n:Stmt a="1"><x/>é</n:Stmt>', "<n:Stmt/>", "<n:Stmt >2</n:Stmt >"]
    assert [(r[0], r[1]) for r in got] == [("a", 0), ("a", 1), ("a", 2)] and all(text.encode()[r[2] :].startswith(r[3].encode()) for r in got)
