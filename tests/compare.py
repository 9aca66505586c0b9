"""Run a Spark query and its SQL twin and compare rows, names and types."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_TYPES = {
    T.LongType: "BIGINT", T.IntegerType: "INTEGER", T.StringType: "VARCHAR", T.DoubleType: "DOUBLE",
    T.BooleanType: "BOOLEAN",
}


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def difference(spark_df, con, sql: str) -> str | None:
    """What differs, or None."""
    expected = con.execute(sql)
    names = sorted(c[0] for c in expected.description)
    types = {c[0]: str(c[1]) for c in expected.description}
    if sorted(spark_df.columns) != names:
        return f"columns {sorted(spark_df.columns)} != {names}"
    for field in spark_df.schema.fields:
        ours = _TYPES.get(type(field.dataType), str(field.dataType))
        if ours != types[field.name]:
            return f"type of {field.name}: {ours} != {types[field.name]}"
    order = [c[0] for c in expected.description]
    want = Counter(expected.fetchall())
    got = Counter(tuple(r) for r in spark_df.select(*[f"`{c}`" for c in order]).collect())
    if want == got:
        return None
    return f"rows {sum(got.values())} vs {sum(want.values())}; extra {list((got - want).items())[:3]}; missing {list((want - got).items())[:3]}"
