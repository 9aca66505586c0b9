"""Wide tables: an id column, a label column and one column per sequence step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmodel.functions.text import is_positive_label, wide_symbols
from seqmodel.sources.conn_log import Layout, files_of, first_lines, read_lines, some_rows, union_inputs, with_fields

# The required columns and the step columns' prefix.
ID, LABEL, STEP_PREFIX = "hash", "malware", "t_"


def step_columns(names: list[str]) -> list[str]:
    return [n for n in names if n.startswith(STEP_PREFIX) and len(n) > len(STEP_PREFIX)]


def wide_sequences(rows: DataFrame, id_column: str, label_column: str, steps: list[str],
                   keep_empty: bool = False) -> DataFrame:
    """Rows to (id, symbols, label); rows without any symbol are dropped."""
    out = rows.select(
        F.col(id_column).alias("id"),
        wide_symbols([F.col(c) for c in steps]).alias("symbols"),
        is_positive_label(F.col(label_column)).alias("label"),
    )
    return out if keep_empty else out.filter(F.size("symbols") > 0)


def read_wide_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Comma-delimited files whose first line is the header; `#` has no meaning here."""
    parts = []
    for header, files in first_lines(spark, files_of(spark, paths), any_line=True).items():
        layout = Layout.of(header, (ID, LABEL), delimiter=",")
        index_of = layout.index
        steps = sorted(step_columns(list(index_of)), key=index_of.get)
        rows = with_fields(read_lines(spark, files, comments=False), layout)
        rows = rows.filter(F.size("fields") > index_of[LABEL])
        cells = {f"c{i}": F.get("fields", F.lit(index_of[n])) for i, n in enumerate(steps)}
        named = rows.select(
            F.coalesce(layout.field(F.col("fields"), ID), F.lit("")).alias(ID),
            layout.field(F.col("fields"), LABEL).alias(LABEL),
            *[cell.alias(name) for name, cell in cells.items()],
            "source",
        )
        parts.append(
            wide_sequences(named, ID, LABEL, list(cells))
        )
    return some_rows(union_inputs(parts))
