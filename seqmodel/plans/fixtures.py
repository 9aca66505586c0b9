"""Inputs made from the given tables, each with the SQL that makes the same rows.

Fragments named ``*_EXPR`` are read by both engines, so both start from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmodel.functions.once import with_once
from seqmodel.functions.text import record_symbols
from seqmodel.operators.sessions import session_sequences
from seqmodel.sources.wide_table import wide_sequences


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(column: str = "symbols"):
    return F.array_join(column, "|")


# Event sessions: one sequence per user and day, positive when some value is above 60.

SESSION_KEYS, SESSION_ORDER, SESSION_LIMIT = ["user_id", "day"], ["ts", "event_id"], 60


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("day"), "ts", "event_id", "value",
        F.concat(F.lit("event="), "event_type").alias("symbol"),
    )


def session_label():
    return F.max("value") > SESSION_LIMIT


def sessions(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    events = session_events(spark, sf_dir)
    events = events if where is None else events.filter(where)
    return session_sequences(events, SESSION_KEYS, SESSION_ORDER, F.col("symbol"), session_label())


def sessions_sql(name: str = "seqs", where: str = "true") -> str:
    return f"""{name}_ev as (
  select user_id, cast(ts as date) as day, ts, event_id, 'event=' || event_type as symbol, value
  from events where {where}),
{name} as (
  select user_id || '|' || day as id,
         list(symbol order by ts, event_id) as symbols, max(value) > {SESSION_LIMIT} as label
  from {name}_ev group by user_id, day)"""


# Records: one sequence of three symbols per order, positive for a large total.


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


RECORD_COLUMNS = [("o_orderstatus", "status="), ("o_orderpriority", "priority="),
                  ("c_mktsegment", "segment=")]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_rows(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"),
        record_symbols([(F.col(c), p) for c, p in RECORD_COLUMNS]).alias("symbols"),
        (F.col("o_totalprice") > 250000).alias("label"),
    )


RECORDS_SQL = """recs as (
  select o_orderkey as id,
         ['status=' || o_orderstatus, 'priority=' || o_orderpriority, 'segment=' || c_mktsegment] as symbols,
         o_totalprice > 250000 as label
  from orders join customer on o_custkey = c_custkey)"""

# Records with missing values: an absent status, a dash for a priority, an empty segment.
SPARSE_EXPR = {
    "status": "case when o_orderstatus = 'P' then null else o_orderstatus end",
    "priority": "case when o_orderpriority in ('1-URGENT', '5-LOW') then '-' else o_orderpriority end",
    "segment": "case when c_mktsegment in ('BUILDING', 'MACHINERY') then '' else c_mktsegment end",
}

# Wide table: three step columns, positive for a high price. Some rows are empty throughout.
WIDE_EXPR = {
    "id": "p_partkey",
    "t_1": "case when p_brand = 'Brand#1' then null else p_brand end",
    "t_2": "case when p_size > 25 then '' else p_type end",
    "t_3": "case when p_size between 20 and 30 then '' else cast(p_size as string) end",
    "kind": "case when p_retailprice > 950 then 'malware' else 'benign' end",
}
SPARSE_WIDE_EXPR = {**WIDE_EXPR, "t_1": "case when p_size > 10 then null else p_brand end"}
STEPS = ["t_1", "t_2", "t_3"]


def selected(exprs: dict[str, str]) -> list[str]:
    return [f"{expr} as {name}" for name, expr in exprs.items()]


def wide(spark: SparkSession, sf_dir: str, exprs=WIDE_EXPR, keep_empty: bool = False) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr(*selected(exprs))
    return wide_sequences(rows, "id", "kind", STEPS, keep_empty)


def wide_sql(exprs=WIDE_EXPR, keep_empty: bool = False) -> str:
    return f"""wide_rows as (select {', '.join(selected(exprs))} from part),
wide as (
  select id, list_filter([t_1, t_2, t_3], lambda x: x is not null and x <> '') as symbols,
         kind = 'malware' as label
  from wide_rows where {'true' if keep_empty else "coalesce(t_1, '') || coalesce(t_2, '') || coalesce(t_3, '') <> ''"})"""


# Delimited log lines: every order gives one line of one of two files, with every irregularity.

HEADERS = {
    "edge.log": "ts|uid|id.orig_h|id.resp_h|proto|service|conn_state|label|detailed-label",
    "edge.csv": "uid,proto,label,conn_state,label,ts",
}
SOURCE_EXPR = "case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'edge.csv' else 'edge.log' end"
_KEY = "cast(o_orderkey as string)"
_TS = f"""case o_orderkey % 13 when 0 then '' when 1 then 'x' when 2 then {_KEY} || '.5x' when 3 then '-'
  when 4 then ' 12.25 ' when 5 then '1e3s' when 6 then '-7.5' when 7 then '.5'
  else '15' || {_KEY} || '.25' end"""
_UID = f"case o_orderkey % 5 when 0 then '-' when 1 then '' else 'C' || {_KEY} end"
_PROTO = """case when o_orderkey % 17 = 5 then '  tcp' || chr(9) when o_orderkey % 17 = 6 then '-'
  when o_orderkey % 17 = 7 then '' when o_orderstatus = 'F' then 'tcp' when o_orderstatus = 'O' then 'udp'
  else 'icmp' end"""
_SERVICE = """case substring(o_orderpriority, 1, 1) when '3' then '-' when '4' then 'dns' else '"ssl"' end"""
_STATE = "case o_custkey % 4 when 0 then 'S0' when 1 then 'SF' when 2 then 'REJ' else '-' end"
_LABEL = r'''case o_orderkey % 19 when 0 then 'Malicious C&C' when 1 then 'Benign' when 2 then 'MALWARE'
  when 3 then 'Malware-x' when 4 then '1' when 5 then '0' when 6 then '' when 7 then 'true'
  when 8 then 'False' when 9 then '"Malicious|x,y"' when 10 then '"a ""malic"" b"'
  when 11 then 'is "" "malic"ious' when 12 then '"open malicious'
  when 13 then '"""malic"""'
  else case when o_totalprice > 250000 then 'Malicious' else 'Benign' end end'''


FIELD_EXPR = {
    "k": "o_orderkey", "source": SOURCE_EXPR, "ts": _TS, "uid": _UID,
    "host": "'10.0.0.' || cast(o_custkey as string)", "proto": _PROTO, "service": _SERVICE,
    "conn_state": _STATE, "label": _LABEL,
}
PIECE_EXPR = {
    "k": "k", "source": "source",
    "head": "case source when 'edge.csv' then uid || ',' || proto else ts || '|' || uid end",
    "body": """case source when 'edge.csv' then ',Benign,' || conn_state || ',' || label
  else '|' || host || '|192.168.0.1|' || proto || '|' || service || '|' || conn_state || '|' || label end""",
    "tail": "case source when 'edge.csv' then ',' || ts else '|-' end",
    "more": "case source when 'edge.csv' then ',x,y' else '|x|y' end",
}
LINE_EXPR = {
    "k": "k", "source": "source",
    "value": """case k % 23 when 0 then '#' || head || body || tail when 1 then '' when 2 then head
  when 3 then head || body when 4 then head || body || tail || more
  when 5 then head || body || tail || chr(13) when 6 then ' #' || head || body || tail
  else head || body || tail end""",
}


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    for exprs in (FIELD_EXPR, PIECE_EXPR, LINE_EXPR):
        rows = rows.selectExpr(*selected(exprs))
    return with_once(rows, "value", F.col("value"))


LINES_SQL = f"""log_fields as (select {', '.join(selected(FIELD_EXPR))} from orders),
log_pieces as (select {', '.join(selected(PIECE_EXPR))} from log_fields),
lines as (select {', '.join(selected(LINE_EXPR))} from log_pieces),
data_lines as (
  select *, case source when 'edge.csv' then ',' else '|' end as delim
  from lines where value <> '' and value[1] <> '#')"""

# A character machine, one step per round; independent of how the Spark side splits.
FIELDS_SQL = f"""{LINES_SQL},
machine as (
  select k, source, value, delim, 1 as i, false as q, '' as cur, cast([] as varchar[]) as done
  from data_lines
  union all
  select k, source, value, delim,
         case when c = '"' and q and n = '"' then i + 2 else i + 1 end,
         case when c = '"' and not (q and n = '"') then not q else q end,
         case when c = '"' then case when q and n = '"' then cur || '"' else cur end
              when c = delim and not q then '' else cur || c end,
         case when c = delim and not q then list_append(done, trim(cur, e' \\t\\n\\x0b\\f\\r')) else done end
  from (select *, substr(value, i, 1) as c, substr(value, i + 1, 1) as n from machine
        where i <= length(value))),
split as (
  select k, source, value, delim, list_append(done, trim(cur, e' \\t\\n\\x0b\\f\\r')) as fields
  from machine where i > length(value))"""

BOUND_SQL = f"""{FIELDS_SQL},
bound as (
  select *, case source when 'edge.csv' then 5 else 8 end as label_at,
         coalesce(case source when 'edge.csv' then fields[6] else fields[1] end, '') as ts,
         coalesce(case source when 'edge.csv' then fields[1] else fields[2] end, '') as uid,
         coalesce(case source when 'edge.csv' then null else fields[3] end, '') as host,
         coalesce(case source when 'edge.csv' then null else fields[4] end, '') as resp_host,
         coalesce(case source when 'edge.csv' then fields[2] else fields[5] end, '') as proto,
         coalesce(case source when 'edge.csv' then null else fields[6] end, '') as service,
         coalesce(case source when 'edge.csv' then fields[4] else fields[7] end, '') as conn_state,
         coalesce(case source when 'edge.csv' then fields[5] else fields[8] end, '') as label_text
  from split),
rows_ok as (
  select *, (lower(label_text) in ('1', 'true', 'malware'))
            or (lower(label_text) not in ('0', 'false', 'benign') and contains(lower(label_text), 'malic')) as label,
         coalesce(try_cast(regexp_extract(ts, '^\\s*([-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?)', 1)
                  as double), 0.0) as ts_number,
         list_filter([case when proto not in ('', '-') then 'proto=' || proto end,
                      case when conn_state not in ('', '-') then 'state=' || conn_state end,
                      case when service not in ('', '-') then 'service=' || service end],
                     lambda x: x is not null) as found
  from bound where len(fields) >= label_at)"""

# Conversations with rules: a user turn asks, an assistant turn answers, END closes.

TURN_END, TURN_PUSH, TURN_POP = "END", "role=user", "role=assistant"
TURN_RULES = [
    (0, "Start", None, None, ["Z0"], "Ready"),
    (1, "Ready", "role=system", None, [], "Ready"),
    (2, "Ready", "role=user", None, ["ASK"], "Waiting"),
    (3, "Waiting", "role=assistant", "ASK", [], "Ready"),
    (4, "Ready", "END", "Z0", [], "Accept"),
]

# Answers stay on the stack; at the end it is emptied without input, which an open question stops.
UNWINDING_RULES = [
    (0, "Start", None, None, ["Z0"], "Open"),
    (1, "Open", "role=system", None, [], "Open"),
    (2, "Open", "role=user", None, ["ASK"], "Open"),
    (3, "Open", "role=assistant", "ASK", ["REPLY"], "Open"),
    (4, "Open", "END", None, [], "Unwind"),
    (5, "Unwind", None, "REPLY", [], "Unwind"),
    (6, "Unwind", None, "Z0", [], "Accept"),
]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("role="), "role").alias("symbol")
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    size = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "medium").otherwise("long")
    return documents.join(table(spark, sf_dir, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("source"),
        F.array(F.concat(F.lit("source="), "source"), F.concat(F.lit("size="), size)).alias("symbols"),
        (F.col("quality") == 1).alias("label"),
    )


LABELLED_SQL = """docs as (
  select doc_id as id, lang as source, quality = 1 as label,
         ['source=' || source,
          'size=' || case when n_chars < 500 then 'short' when n_chars < 2000 then 'medium' else 'long' end] as symbols
  from documents join labels using (doc_id))"""


# A given automaton over whole histories: views and clicks go round in circles, some pairs have no transition.

GIVEN_START = "Idle"
GIVEN_STATES = [("Idle", False), ("Looking", False), ("Busy", True), ("Done", True)]
GIVEN_MOVES = [
    ("Idle", "event=view", "Looking"), ("Idle", "event=click", "Busy"), ("Looking", "event=view", "Looking"),
    ("Looking", "event=click", "Busy"), ("Looking", "event=purchase", "Done"), ("Busy", "event=view", "Looking"),
    ("Busy", "event=click", "Busy"), ("Busy", "event=purchase", "Done"), ("Done", "event=view", "Idle"),
]


def given_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return (
        spark.createDataFrame(GIVEN_STATES, "state string, accepting boolean"),
        spark.createDataFrame(GIVEN_MOVES, "state string, symbol string, next_state string"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{c}'" if isinstance(c, str) else str(c).lower() for c in r) + ")" for r in rows)


#: Histories are walked symbol by symbol, one step a round; the state stays where ``on_missing`` says so.
GIVEN_SQL = f"""given_states(state, accepting) as (values {_values(GIVEN_STATES)}),
given_moves(state, symbol, next_state) as (values {_values(GIVEN_MOVES)}),
histories as (
  select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
         'event=' || event_type as symbol from events),
lengths as (select user_id, count(*) as n from histories group by user_id),
walk as (
  select user_id, 0::bigint as i, null::varchar as before, null::varchar as symbol, '{GIVEN_START}' as state, false as lost from lengths
  union all
  select w.user_id, w.i + 1, w.state, h.symbol, coalesce(m.next_state, w.state), m.next_state is null
  from walk w join histories h on h.user_id = w.user_id and h.pos = w.i
  left join given_moves m on m.state = w.state and m.symbol = h.symbol
  where {{on}})"""
