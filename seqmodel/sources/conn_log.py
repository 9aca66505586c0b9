"""Connection logs: `|` or `,` delimited text, a header naming the columns, `#` comments.

Every file has its own header. The headers are fetched on the driver, one tiny job per file that
stops at the first line (pass ``header`` to skip that when it is known). Files with the same header
are then read by one scan.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmodel.functions.once import with_once
from seqmodel.functions.text import (
    is_positive_label, leading_number, record_symbols, split_fields,
)
from seqmodel.operators.ordered import ordered
from seqmodel.sources.scratch import written

# Column names and the symbol prefix of each feature column, in symbol order.
LABEL = "label"
FEATURES = (("proto", "proto="), ("conn_state", "state="), ("service", "service="))
TEXT_COLUMNS = (("host", "id.orig_h"), ("resp_host", "id.resp_h"), ("uid", "uid"))
TIME = "ts"

BLOCK = "split_start"

# Drawn anew in each process, so that no line holds it.
_NEVER = f"\u0001{uuid.uuid4().hex}\u0001"


def delimiter_of(header: str) -> str:
    return "|" if "|" in header else ","


def header_names(header: str, delimiter: str) -> list[str]:
    """Header fields by the same rule as the rows; Spark evaluates it on the one header string."""
    spark = SparkSession.active()
    return spark.range(1).select(split_fields(F.lit(header), delimiter)).first()[0]


@dataclass(frozen=True)
class Layout:
    """Where each named column sits; the last of several equal names wins."""

    delimiter: str
    index: dict[str, int]

    @classmethod
    def of(cls, header: str, required: tuple[str, ...] = (LABEL,),
           delimiter: str | None = None) -> "Layout":
        delimiter = delimiter or delimiter_of(header)
        index = {name: i for i, name in enumerate(header_names(header, delimiter))}
        missing = [name for name in required if name not in index]
        if missing:
            raise ValueError(f"missing required column: {', '.join(missing)}")
        return cls(delimiter, index)

    def field(self, fields: Column, name: str) -> Column:
        """The named cell, null when the header or the row does not reach it."""
        if name not in self.index:
            return F.lit(None).cast("string")
        return F.get(fields, F.lit(self.index[name]))


def is_data_line(line: Column) -> Column:
    return (line != "") & ~line.startswith("#")


def data_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    return lines.filter(is_data_line(F.col(column)))


def with_fields(lines: DataFrame, layout: Layout, column: str = "value") -> DataFrame:
    return with_once(lines, "fields", split_fields(F.col(column), layout.delimiter))


def reaches_label(layout: Layout, label: str = LABEL) -> Column:
    """Rows that end before the label column are malformed; longer and slightly short ones are not."""
    return F.size("fields") > layout.index[label]


def parse_lines(lines: DataFrame, header: str) -> DataFrame:
    """(source, value) lines of one header to labelled sequences; ``split_start`` stays where there is one."""
    layout = Layout.of(header)
    rows = with_fields(data_lines(lines), layout).filter(reaches_label(layout))
    cell = lambda name: layout.field(F.col("fields"), name)
    texts = [F.coalesce(cell(name), F.lit("")).alias(out) for out, name in TEXT_COLUMNS]
    return rows.select(
        line_id(F.col("source"), F.col("value"), cell("uid")).alias("id"),
        *texts,
        leading_number(cell(TIME)).alias("ts"),
        record_symbols([(cell(name), prefix) for name, prefix in FEATURES]).alias("symbols"),
        is_positive_label(cell(LABEL)).alias("label"),
        F.col("source"),
        *[c for c in lines.columns if c == BLOCK],
    )


def rejected_lines(lines: DataFrame, header: str) -> DataFrame:
    """The malformed lines of one header, as they are."""
    layout = Layout.of(header)
    return with_fields(data_lines(lines), layout).filter(~reaches_label(layout)).select(lines.columns)


def line_id(source: Column, line: Column, uid: Column | None = None) -> Column:
    """`uid` where there is one, else a digest of file and line. No shuffle; equal lines share it."""
    digest = F.sha2(F.concat_ws("\n", source, line), 256)
    if uid is None:
        return digest
    return F.when(uid.isNotNull() & ~uid.isin("", "-"), uid).otherwise(digest)


def unique_ids(rows: DataFrame, id_column: str = "id", limit: int | None = None,
               order: tuple[str, ...] = ()) -> DataFrame:
    """Give the n-th row of equal ids the suffix `#n` (n >= 2), so that ids tell rows apart.

    Rows count by ``order`` and then by their place in a split: with (file, start of the split) that is the place in
    the file, however the files are split. Only hashes of the ids and rows of repeated ids are shuffled.
    """
    key = F.xxhash64(id_column)
    repeated = rows.groupBy(key.alias("__key")).count().filter("count > 1").select("__key")
    repeated = written(repeated, "repeated", lookup=True)
    if repeated.isEmpty():
        return rows
    marked = rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__key", key)
    several = marked.join(repeated, "__key", "left_semi").drop("__key")
    ranked = ordered(several, [id_column], [*order, "__row"], limit).running_sum(F.lit(1), "__copy").rows()
    suffix = F.concat(F.col(id_column), F.lit("#"), F.col("__copy").cast("string"))
    named = ranked.withColumn(id_column, F.when(F.col("__copy") > 1, suffix).otherwise(F.col(id_column)))
    return marked.join(repeated, "__key", "left_anti").select(rows.columns).unionByName(named.select(rows.columns))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """``lines`` as ``read_lines`` returns them with ``line_no``, 1, 2, ... within each file, however it is split.

    Lines are counted per split and the counts summed along the file; a line adds its place in the split. No line is
    shuffled while the counts, a row per split, are small enough to be sent to the tasks.
    """
    placed = lines.withColumn("__row", F.monotonically_increasing_id())
    counts = placed.groupBy("source", BLOCK).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__lines"))
    before = ordered(counts, ["source"], [BLOCK]).running_sum(F.col("__lines"), "__before", inclusive=False).rows()
    starts = written(before.select("source", BLOCK, (F.col("__before") - F.col("__first")).alias("__shift")), "splits", lookup=True)
    number = F.col("__row") + F.col("__shift") + 1
    return placed.join(starts, ["source", BLOCK]).select(*lines.columns, number.alias("line_no"))


def read_lines(spark: SparkSession, paths: list[str], comments: bool = True) -> DataFrame:
    """(source, split_start, value): the lines of the files without header, comments and blank lines.

    The CSV reader drops exactly the first such line of each file, whatever the splits. With a
    delimiter and quote that never occur it leaves the lines whole.
    """
    return (
        spark.read.schema("value string")
        .options(sep=_NEVER, quote="", comment="#" if comments else "", lineSep="\n", header=True,
                 recursiveFileLookup=True)
        .csv(paths)
        .select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias(BLOCK), "value")
        .filter(F.col("value").isNotNull())
    )


def files_of(spark: SparkSession, paths: list[str]) -> list[str]:
    return spark.read.option("recursiveFileLookup", True).text(paths).inputFiles()


def first_lines(spark: SparkSession, files: list[str], any_line: bool = False) -> dict[str, list[str]]:
    """header -> files. Each lookup reads the beginning of one file."""
    wanted = F.col("value") != "" if any_line else is_data_line(F.col("value"))

    def first_line(path: str) -> str | None:
        found = spark.read.text(path, lineSep="\n").filter(wanted).head(1)
        return found[0]["value"] if found else None

    headers: dict[str, list[str]] = defaultdict(list)
    with ThreadPoolExecutor(32) as pool:
        for path, header in zip(files, pool.map(first_line, files)):
            if header is not None:
                headers[header].append(path)
    return dict(headers)


def read_conn_log(spark: SparkSession, paths: list[str], header: str | None = None) -> DataFrame:
    """Labelled sequences of all files. Files without data lines add nothing; all empty is an error."""
    if header is not None:
        rows = parse_lines(read_lines(spark, paths), header)
    else:
        headers = first_lines(spark, files_of(spark, paths))
        rows = union_inputs([parse_lines(read_lines(spark, files), head) for head, files in headers.items()])
    return some_rows(unique_ids(rows, order=("source", BLOCK)).drop(BLOCK))


def some_rows(rows: DataFrame) -> DataFrame:
    """``rows``; inputs that hold headers only are an error. Looks for one row."""
    if rows.isEmpty():
        raise ValueError("no sequences in any input")
    return rows


def union_inputs(inputs: list[DataFrame]) -> DataFrame:
    if not inputs:
        raise ValueError("no sequences in any input")
    return reduce(DataFrame.unionByName, inputs)
