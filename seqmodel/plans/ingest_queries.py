"""Registered queries: sources, record and session sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmodel.functions.text import (
    is_positive_label, leading_number, record_symbols, symbols_from_blanks, symbols_from_commas,
)
from seqmodel.operators.sessions import session_gap_sequences, session_md5s
from seqmodel.plans import fixtures as fx
from seqmodel.sources import conn_log
from seqmodel.sources.conn_log import Layout
from seqmodel.sources.scratch import new_path
from seqmodel.sources.wide_table import read_wide_table

_GAP_SECONDS = 6 * 3600
_LINES_PER_FILE = 20_000_000


def _per_source(lines: DataFrame, use) -> DataFrame:
    """``use(lines of one file, its header)`` for each file, put together."""
    parts = [use(lines.filter(F.col("source") == s), h) for s, h in fx.HEADERS.items()]
    return conn_log.union_inputs(parts)


def _fields(spark, d) -> DataFrame:
    lines = conn_log.data_lines(fx.log_lines(spark, d))
    return _per_source(lines, lambda rows, h: conn_log.with_fields(rows, Layout.of(h)))


def _cells(spark, d, names: dict[str, str], keep_malformed: bool = False) -> DataFrame:
    def bind(rows: DataFrame, header: str) -> DataFrame:
        layout = Layout.of(header)
        rows = conn_log.with_fields(rows, layout)
        if not keep_malformed:
            rows = rows.filter(conn_log.reaches_label(layout))
        cell = lambda name: F.coalesce(layout.field(F.col("fields"), name), F.lit(""))
        return rows.select("k", *[cell(name).alias(out) for out, name in names.items()])

    return _per_source(conn_log.data_lines(fx.log_lines(spark, d)), bind)


def _write_log(lines: DataFrame, header: str, path: str) -> None:
    """Text files that each begin with the header; their number grows with the lines."""
    n = 1 + lines.count() // _LINES_PER_FILE
    rows = lines.select("value", F.pmod(F.xxhash64("k"), F.lit(n)).alias("file"), F.lit(1).alias("rank"))
    heads = lines.sparkSession.range(n).select(
        F.lit(header).alias("value"), F.col("id").alias("file"), F.lit(0).alias("rank")
    )
    rows.unionByName(heads).repartition(n, "file").sortWithinPartitions("file", "rank").select(
        "value", "file"
    ).write.partitionBy("file").text(path, lineSep="\n")


def ingest_conn_log(spark: SparkSession, d: str) -> DataFrame:
    """Lines go to real files, each with its header, and come back through the reader."""
    lines = fx.log_lines(spark, d)
    paths = []
    for source, header in fx.HEADERS.items():
        paths.append(new_path(spark, "conn_log"))
        _write_log(lines.filter(F.col("source") == source), header, paths[-1])
    rows = conn_log.read_conn_log(spark, paths)
    return rows.select("host", "resp_host", "uid", "ts", fx.text().alias("symbols"), "label")


def ingest_rejects(spark: SparkSession, d: str) -> DataFrame:
    """The data lines that end before their label."""
    return _per_source(fx.log_lines(spark, d), lambda rows, h: conn_log.rejected_lines(rows, h).select("k", "value"))


def ingest_wide_table(spark: SparkSession, d: str) -> DataFrame:
    """Wide rows go to text files with a header and come back through the reader."""
    rows = fx.table(spark, d, "part").selectExpr(*fx.selected(fx.WIDE_EXPR))
    cells = ["t_1", "id", "t_2", "kind", "t_3"]
    lines = rows.select(F.col("id").alias("k"), F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cells]).alias("value"))
    path = new_path(spark, "wide_table")
    _write_log(lines, "t_1,hash,t_2,malware,t_3", path)
    return read_wide_table(spark, [path]).select("id", fx.text().alias("symbols"), "label")


def sessions_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Long sessions: one per event type, each with the md5 of its whole text."""
    return session_md5s(
        fx.table(spark, d, "events"), ["event_type"], ["ts", "event_id"],
        F.concat(F.lit("user="), F.pmod("user_id", F.lit(10)).cast("string")), F.max("event_id") % 2 == 0,
    )


def ingest_skip_comments(spark, d):
    return conn_log.data_lines(fx.log_lines(spark, d))


def ingest_delim(spark, d):
    def counted(rows: DataFrame, header: str) -> DataFrame:
        delimiter = conn_log.delimiter_of(header)
        rows = conn_log.with_fields(rows, Layout.of(header))
        return rows.select("source", F.lit(delimiter).alias("delim"), F.size("fields").cast("long").alias("n_fields"))

    rows = _per_source(conn_log.data_lines(fx.log_lines(spark, d)), counted)
    return rows.groupBy("source", "delim", "n_fields").agg(F.count(F.lit(1)).alias("n"))


def ingest_quoted_fields(spark, d):
    return _fields(spark, d).select("k", F.array_join("fields", "~").alias("fields"))


def ingest_bind_columns(spark, d):
    names = {"uid": "uid", "host": "id.orig_h", "proto": "proto", "service": "service",
             "conn_state": "conn_state", "label_text": "label"}
    return _cells(spark, d, names, keep_malformed=True)


def ingest_malformed_split(spark, d):
    def flagged(rows: DataFrame, header: str) -> DataFrame:
        layout = Layout.of(header)
        rows = conn_log.with_fields(rows, layout)
        return rows.select("k", (~conn_log.reaches_label(layout)).alias("rejected"))

    return _per_source(conn_log.data_lines(fx.log_lines(spark, d)), flagged)


def label_normalize(spark, d):
    return _cells(spark, d, {"label_text": "label"}).select(
        "k", "label_text", is_positive_label(F.col("label_text")).alias("label")
    )


def ts_parse(spark, d):
    return _cells(spark, d, {"ts": "ts"}).select("k", leading_number(F.col("ts")).alias("ts"))


def sample_id(spark, d):
    rows = fx.table(spark, d, "orders").select(
        F.col("o_orderstatus").alias("source"),
        F.concat_ws("|", "o_orderpriority", F.year("o_orderdate").cast("string")).alias("value"),
    )
    rows = rows.select("source", conn_log.line_id(F.col("source"), F.col("value")).alias("id"))
    return conn_log.unique_ids(rows)


def record_symbols_query(spark, d):
    return fx.records(spark, d).select("id", fx.text().alias("symbols"), "label")


def record_sentinel(spark, d):
    rows = fx.order_rows(spark, d).selectExpr("o_orderkey as id", *fx.selected(fx.SPARSE_EXPR))
    columns = [(F.col(name), f"{name}=") for name in fx.SPARSE_EXPR]
    return rows.select("id", F.array_join(record_symbols(columns), "|").alias("symbols"))


def wide_sequences(spark, d):
    return fx.wide(spark, d).select("id", fx.text().alias("symbols"), "label")


def wide_drop_empty(spark, d):
    return fx.wide(spark, d, fx.SPARSE_WIDE_EXPR).select("id", fx.text().alias("symbols"))


def inputs(spark, d) -> DataFrame:
    """Sessions and records as two inputs of one run."""
    ids = lambda df, source: df.select(
        F.col("id").cast("string").alias("id"), "symbols", "label", F.lit(source).alias("source")
    )
    return conn_log.union_inputs(
        [ids(fx.sessions(spark, d), "sessions"), ids(fx.records(spark, d), "records")]
    )


INPUTS_SQL = f"""{fx.sessions_sql()}, {fx.RECORDS_SQL},
inputs as (
  select id, symbols, label, 'sessions' as source from seqs
  union all
  select cast(id as varchar), symbols, label, 'records' from recs)"""


def union_inputs(spark, d):
    return inputs(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("label").alias("positive"),
        F.sum(F.size("symbols")).alias("n_symbols"),
    )


def session_sequences(spark, d):
    return fx.sessions(spark, d).select("id", fx.text().alias("symbols"), "label")


def session_gaps(spark, d):
    events = fx.session_events(spark, d)
    seqs = session_gap_sequences(
        events, ["user_id"], "ts", "event_id", _GAP_SECONDS, F.col("symbol"), fx.session_label()
    )
    return seqs.select("id", fx.text().alias("symbols"), "label")


def parse_sequence_text(spark, d):
    texts = fx.table(spark, d, "documents").select("doc_id", "text")
    commas, blanks = symbols_from_commas(F.col("text")), symbols_from_blanks(F.col("text"))
    return texts.select(
        "doc_id", F.size(commas).cast("long").alias("n_commas"), F.size(blanks).cast("long").alias("n_blanks"),
        F.md5(F.array_join(commas, "~")).alias("commas"), F.md5(F.array_join(blanks, "~")).alias("blanks"),
    )


QUERIES = {
    "ingest_conn_log": ingest_conn_log,
    "ingest_skip_comments": ingest_skip_comments,
    "ingest_delim": ingest_delim,
    "ingest_quoted_fields": ingest_quoted_fields,
    "ingest_bind_columns": ingest_bind_columns,
    "ingest_malformed_split": ingest_malformed_split,
    "ingest_rejects": ingest_rejects,
    "ingest_wide_table": ingest_wide_table,
    "label_normalize": label_normalize,
    "ts_parse": ts_parse,
    "sample_id": sample_id,
    "record_symbols": record_symbols_query,
    "record_sentinel": record_sentinel,
    "wide_sequences": wide_sequences,
    "wide_drop_empty": wide_drop_empty,
    "union_inputs": union_inputs,
    "session_sequences": session_sequences,
    "sessions_by_type": sessions_by_type,
    "session_gap_sequences": session_gaps,
    "parse_sequence_text": parse_sequence_text,
}

_WIDE_TEXT = "select id, array_to_string(symbols, '|') as symbols"

ORACLES = {
    "ingest_conn_log": f"""with recursive {fx.BOUND_SQL}
select host, resp_host, uid, ts_number as ts, label,
       case when len(found) = 0 then 'symbol=unknown' else array_to_string(found, '|') end as symbols
from rows_ok""",
    "ingest_skip_comments": f"with {fx.LINES_SQL} select k, source, value from data_lines",
    "ingest_delim": f"""with recursive {fx.FIELDS_SQL}
select source, delim, len(fields) as n_fields, count(*) as n from split group by all""",
    "ingest_quoted_fields": f"""with recursive {fx.FIELDS_SQL}
select k, array_to_string(fields, '~') as fields from split""",
    "ingest_bind_columns": f"""with recursive {fx.BOUND_SQL}
select k, uid, host, proto, service, conn_state, label_text from bound""",
    "ingest_rejects": f"""with recursive {fx.BOUND_SQL}
select k, value from bound where len(fields) < label_at""",
    "ingest_wide_table": f"""with {fx.wide_sql()}
select cast(id as varchar) as id, array_to_string(symbols, '|') as symbols, label from wide""",
    "sessions_by_type": """select event_type as id, count(*) as n,
       md5(string_agg('user=' || user_id % 10, '|' order by ts, event_id)) as symbols,
       max(event_id) % 2 = 0 as label from events group by event_type""",
    "ingest_malformed_split": f"""with recursive {fx.BOUND_SQL}
select k, len(fields) < label_at as rejected from bound""",
    "label_normalize": f"with recursive {fx.BOUND_SQL} select k, label_text, label from rows_ok",
    "ts_parse": f"with recursive {fx.BOUND_SQL} select k, ts_number as ts from rows_ok",
    "sample_id": """with ids as (
  select o_orderstatus as source,
         sha256(o_orderstatus || chr(10) || o_orderpriority || '|' || year(o_orderdate)) as id from orders),
ranked as (select *, row_number() over (partition by id) as n from ids)
select source, case when n > 1 then id || '#' || n else id end as id from ranked""",
    "record_symbols": f"""with {fx.RECORDS_SQL}
select id, array_to_string(symbols, '|') as symbols, label from recs""",
    "record_sentinel": f"""with rows as (
  select o_orderkey as id, {', '.join(fx.selected(fx.SPARSE_EXPR))}
  from orders join customer on o_custkey = c_custkey),
found as (
  select id, concat_ws('|', case when status not in ('', '-') then 'status=' || status end,
                       case when priority not in ('', '-') then 'priority=' || priority end,
                       case when segment not in ('', '-') then 'segment=' || segment end) as symbols from rows)
select id, case when symbols = '' then 'symbol=unknown' else symbols end as symbols from found""",
    "wide_sequences": f"with {fx.wide_sql()} {_WIDE_TEXT}, label from wide",
    "wide_drop_empty": f"with {fx.wide_sql(fx.SPARSE_WIDE_EXPR)} {_WIDE_TEXT} from wide",
    "union_inputs": f"""with {INPUTS_SQL}
select source, count(*) as n, count(*) filter (label) as positive, cast(sum(len(symbols)) as bigint) as n_symbols
from inputs group by source""",
    "session_sequences": f"""with {fx.sessions_sql()}
select id, array_to_string(symbols, '|') as symbols, label from seqs""",
    "session_gap_sequences": f"""with before as (
  select *, lag(ts) over (partition by user_id order by ts, event_id) as prev from events),
sess as (
  select *, sum(case when date_diff('microsecond', prev, ts) > {_GAP_SECONDS * 1_000_000} then 1 else 0 end)
            over (partition by user_id order by ts, event_id) as session from before)
select user_id || '|' || session as id,
       string_agg('event=' || event_type, '|' order by ts, event_id) as symbols,
       max(value) > {fx.SESSION_LIMIT} as label
from sess group by user_id, session""",
    "parse_sequence_text": r"""with parts as (
  select doc_id,
         case when text = '' then [] else
           list_transform(string_split(case when text like '%,' then text[:-2] else text end, ','),
                          lambda x: trim(x, e' \t\n\x0b\f\r')) end as commas,
         list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as blanks
  from documents)
select doc_id, len(commas) as n_commas, len(blanks) as n_blanks,
       md5(array_to_string(commas, '~')) as commas, md5(array_to_string(blanks, '~')) as blanks
from parts""",
}
