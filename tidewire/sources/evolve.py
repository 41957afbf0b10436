"""Tables whose layout grows: old files stay as they are, and reading gives all of them in one layout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType, NumericType, StringType, StructType

from tidewire.sources.inbox import read_or_empty


def _layouts(spark: SparkSession, folder: str) -> list[str]:
    """The folders of a table's layouts, oldest first: one per change, not per write."""
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top)] if fs.exists(top) else []
    return [f"{folder}/{n}" for n in sorted((n for n in names if n.startswith("layout=")), key=lambda n: int(n[7:]))]


def wider(a: DataType, b: DataType) -> DataType:
    """The type that holds the values of both: the larger integer, a double for an integer and a double, else text."""
    if a == b:
        return a
    if isinstance(a, IntegralType) and isinstance(b, IntegralType):
        return max(a, b, key=lambda t: ("byte", "short", "integer", "long").index(t.typeName()))
    doubles = {t.typeName() for t in (a, b)} <= {"byte", "short", "integer", "float", "double"} and isinstance(a, NumericType)
    return (a if a.typeName() == "double" else b) if doubles and "double" in (a.typeName(), b.typeName()) else StringType()


def changes(stored: StructType, wanted: StructType) -> list[tuple[str, str, str | None, str | None]]:
    """(column, added, dropped or changed, the stored type, the wanted one) of what differs."""
    old, new = ({f.name: f.dataType.simpleString() for f in s} for s in (stored, wanted))
    kind = lambda c: "added" if c not in old else "dropped" if c not in new else "changed"
    return [(c, kind(c), old.get(c), new.get(c)) for c in [*old, *(c for c in new if c not in old)] if old.get(c) != new.get(c)]


def append(df: DataFrame, folder: str) -> list[tuple[str, str, str | None, str | None]]:
    """Append df to the table; under a layout of its own if its columns or types differ from the last one's. Returns the changes."""
    spark = df.sparkSession
    layouts = _layouts(spark, folder)
    found = changes(spark.read.parquet(layouts[-1]).schema, df.schema) if layouts else []
    number = int(layouts[-1].rpartition("=")[2]) + bool(found) if layouts else 0
    df.write.mode("append").parquet(f"{folder}/layout={number}")
    return found


def read(spark: SparkSession, folder: str, wanted: StructType | None = None) -> DataFrame:
    """The whole table in the layout wanted, by default all columns that any layout has in the widest type; what a layout lacks is
    null, values of other types are cast."""
    tables = [spark.read.parquet(p) for p in _layouts(spark, folder)]
    if wanted is None:
        types: dict[str, DataType] = {}
        for f in (f for t in tables for f in t.schema):
            types[f.name] = wider(types[f.name], f.dataType) if f.name in types else f.dataType
        wanted = reduce(lambda s, c: s.add(c, types[c]), types, StructType())
    one = lambda t: t.select(*((F.col(f"`{f.name}`") if f.name in t.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
    return reduce(DataFrame.unionByName, map(one, tables)) if tables else read_or_empty(spark, f"{folder}/layout=0", wanted)
