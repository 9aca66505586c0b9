"""Registered queries: push/pop checks and pushdown rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqmodel.functions.stack import ACCEPTED, check_symbols, stack_reason
from seqmodel.operators import rules as pushdown
from seqmodel.operators import stack
from seqmodel.operators.rules import Rules
from seqmodel.plans import fixtures as fx

_PUSH, _POP = "event=view", "event=purchase"
_CONTROL = {"view": "LOOKING", "purchase": "BUYING"}
_RECORD_PUSH, _RECORD_POP = "priority=1-URGENT", "segment=BUILDING"

LABEL_EXPR = """case p_partkey % 6
  when 0 then p_brand || ', ε -> ' || p_type when 1 then p_brand || ',' || p_type || '->ε'
  when 2 then 'ε , ' || p_brand || ' ->  ' || p_type || '  ' || p_name
  when 3 then p_name when 4 then p_brand || ' -> ' || p_name || ', ' || p_type
  else ' ,  -> ' end"""


def stack_balance(spark, d):
    return stack.stack_balance(
        fx.session_events(spark, d), fx.SESSION_KEYS, fx.SESSION_ORDER, push=_PUSH, pop=_POP
    ).select(F.concat_ws("|", "user_id", "day").alias("id"), "ok", "reason")


def stack_balance_turns(spark, d):
    return stack.stack_balance(
        fx.turns(spark, d), ["conv_id"], ["turn"], push=fx.TURN_PUSH, pop=fx.TURN_POP
    )


def stack_balance_records(spark, d):
    """Symbols of one record, checked in the row."""
    checked = fx.records(spark, d).withColumn(
        "c", check_symbols(F.col("symbols"), _RECORD_PUSH, _RECORD_POP)
    )
    reason = stack_reason(F.col("c.first_error"), F.col("c.depth"))
    return checked.select("id", (reason == ACCEPTED).alias("ok"), reason.alias("reason"))


def stack_trace(spark, d):
    return stack.stack_trace(
        fx.session_events(spark, d), fx.SESSION_KEYS, fx.SESSION_ORDER, push=_PUSH, pop=_POP,
        prefix="event=", states=_CONTROL,
    ).select(F.concat_ws("|", "user_id", "day").alias("id"), "step", "op", "symbol", "stack_depth",
             "current_state", "next_state")


# Events as symbols of the default form: two of them push and pop, the others name a control state.
_DEFAULT_SYMBOL = """case event_type when 'view' then 'state=S0' when 'purchase' then 'state=SF'
  when 'click' then 'proto=tcp' when 'signup' then 'proto=udp' else 'proto=' || event_type end"""


def stack_trace_full(spark, d):
    """Every step with the stack after it, and the verdict of its sequence; the default symbols."""
    events = fx.session_events(spark, d).withColumn(
        "symbol", F.expr(_DEFAULT_SYMBOL.replace("event_type", "substring(symbol, 7)"))
    )
    trace = stack.stack_trace(events, fx.SESSION_KEYS, fx.SESSION_ORDER)
    verdicts = stack.stack_balance(events, fx.SESSION_KEYS, fx.SESSION_ORDER)
    return trace.join(verdicts, fx.SESSION_KEYS).select(
        F.concat_ws("|", "user_id", "day").alias("id"), "step", "op", "symbol",
        F.array_join(stack.stack_after(F.col("stack_depth")), "|").alias("stack_after"),
        "current_state", "next_state", "ok",
    )


TURN_RULES = Rules(fx.TURN_RULES, "Start", ["Accept"])


def _attempts(spark, d):
    return pushdown.rule_attempts(
        fx.turns(spark, d), "conv_id", ["turn"], "symbol", TURN_RULES, end=fx.TURN_END
    )


def rule_conformance(spark, d):
    return _attempts(spark, d).select("conv_id", "accepted")


def rule_best_attempt(spark, d):
    return _attempts(spark, d).select(
        "conv_id", "accepted", F.array_join(F.col("path").cast("array<string>"), ",").alias("path")
    )


def rule_step_trace(spark, d):
    return pushdown.rule_step_trace(_attempts(spark, d), "conv_id", TURN_RULES).select(
        "conv_id", "step", "op", "symbol", F.array_join("stack_after", "|").alias("stack_after"),
        "current_state", "next_state",
    )


def rule_unwinding(spark, d):
    """Rules with a circle that pops without reading."""
    rules = Rules(fx.UNWINDING_RULES, "Start", ["Accept"])
    attempts = pushdown.rule_attempts(fx.turns(spark, d), "conv_id", ["turn"], "symbol", rules, end=fx.TURN_END)
    return attempts.select(
        "conv_id", "accepted", F.array_join(F.col("path").cast("array<string>"), ",").alias("path")
    )


def rule_table(spark, d):
    labels = fx.table(spark, d, "part").selectExpr("p_partkey as k", f"{LABEL_EXPR} as label")
    return pushdown.rule_table(labels, "label").select(
        "k", "input", "pop", F.array_join("push", "|").alias("push")
    )


QUERIES = {
    "stack_balance": stack_balance,
    "stack_balance_turns": stack_balance_turns,
    "stack_balance_records": stack_balance_records,
    "stack_trace": stack_trace,
    "stack_trace_full": stack_trace_full,
    "rule_conformance": rule_conformance,
    "rule_best_attempt": rule_best_attempt,
    "rule_step_trace": rule_step_trace,
    "rule_unwinding": rule_unwinding,
    "rule_table": rule_table,
}

_REASON = """case when first_error is not null then 'pop without matching push at position ' || first_error
            when depth > 0 then 'final stack not empty (' || depth || ' unmatched pushes)'
            else 'accepted' end"""


def balance_sql(rows: str, key: str) -> str:
    """``rows`` has (key, nth, symbol, effect)."""
    return f"""running as (
  select *, sum(effect) over (partition by {key} order by nth) as depth from {rows}),
ends as (
  select {key}, min(nth) filter (depth < 0) as first_error, cast(sum(effect) as bigint) as depth
  from running group by {key})
select {key}, {_REASON} = 'accepted' as ok, {_REASON} as reason from ends"""


_EVENTS = f"""session_events as (
  select user_id || '|' || cast(ts as date) as id, 'event=' || event_type as symbol,
         case 'event=' || event_type when '{_PUSH}' then 1 when '{_POP}' then -1 else 0 end as effect,
         row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as nth
  from events)"""

_TURN_RULES = """(0, 'Start', null, null, ['Z0'], 'Ready'), (1, 'Ready', 'role=system', null, [], 'Ready'),
  (2, 'Ready', 'role=user', null, ['ASK'], 'Waiting'), (3, 'Waiting', 'role=assistant', 'ASK', [], 'Ready'),
  (4, 'Ready', 'END', 'Z0', [], 'Accept')"""

_UNWINDING_RULES = """(0, 'Start', null, null, ['Z0'], 'Open'), (1, 'Open', 'role=system', null, [], 'Open'),
  (2, 'Open', 'role=user', null, ['ASK'], 'Open'), (3, 'Open', 'role=assistant', 'ASK', ['REPLY'], 'Open'),
  (4, 'Open', 'END', null, [], 'Unwind'), (5, 'Unwind', null, 'REPLY', [], 'Unwind'),
  (6, 'Unwind', null, 'Z0', [], 'Accept')"""


def _search_sql(rules: str) -> str:
    """Breadth first over (state, position, stack, path), stack top first."""
    return f"""with recursive rules(rule_no, state, input, pop, push, next_state) as (values
  {rules}),
seqs as (
  select conv_id, list_append(list('role=' || role order by turn), '{fx.TURN_END}') as symbols
  from conversations group by conv_id),
search as (
  select conv_id, symbols, 'Start' as state, 0 as pos, cast([] as varchar[]) as stack,
         cast([] as integer[]) as path, cast([] as struct(op varchar, symbol varchar, after varchar, a varchar, b varchar)[]) as steps
  from seqs
  union all
  select conv_id, symbols, next_state, pos + (input is not null)::int, after, list_append(path, rule_no),
         list_append(steps, {{'op': case when len(push) > 0 then 'PUSH' when pop is not null then 'POP' else 'NO_OP' end,
                              'symbol': coalesce(input, 'ε'), 'after': array_to_string(list_reverse(after), '|'),
                              'a': state, 'b': next_state}})
  from (select s.*, r.* exclude (state), list_concat(push, case when pop is null then stack else stack[2:] end) as after
        from search s join rules r on r.state = s.state
          and (r.input is null or r.input = s.symbols[s.pos + 1])
          and (r.pop is null or r.pop = s.stack[1]))),
best as (
  select conv_id, bool_or(pos = len(symbols) and state = 'Accept') as accepted,
         arg_min(path, {{'open': not (pos = len(symbols) and state = 'Accept'), 'left': -pos, 'n': len(path), 'path': path}}) as path,
         arg_min(steps, {{'open': not (pos = len(symbols) and state = 'Accept'), 'left': -pos, 'n': len(path), 'path': path}}) as steps,
         max(pos) as consumed
  from search group by conv_id)"""


_SEARCH = _search_sql(_TURN_RULES)

ORACLES = {
    "stack_balance": f"with {_EVENTS}, {balance_sql('session_events', 'id')}",
    "stack_balance_turns": f"""with turn_events as (
  select conv_id, case role when 'user' then 1 when 'assistant' then -1 else 0 end as effect,
         row_number() over (partition by conv_id order by turn) - 1 as nth from conversations),
{balance_sql('turn_events', 'conv_id')}""",
    "stack_balance_records": f"""with {fx.RECORDS_SQL}, items as (
  select id, unnest(symbols) as symbol, generate_subscripts(symbols, 1) - 1 as nth from recs),
record_events as (
  select id, nth, case symbol when '{_RECORD_PUSH}' then 1 when '{_RECORD_POP}' then -1 else 0 end as effect
  from items),
{balance_sql('record_events', 'id')}""",
    "stack_trace": f"""with {_EVENTS}, running as (
  select *, cast(sum(effect) over (partition by id order by nth) as bigint) as depth,
         case symbol when '{_PUSH}' then 'LOOKING' when '{_POP}' then 'BUYING' else 'OTHER' end as next_state
  from session_events),
bad as (select id, min(nth) as first_error from running where depth < 0 group by id)
select id, nth as step, symbol,
       case when depth < 0 then 'POP_ERROR' when effect = 1 then 'PUSH' when effect = -1 then 'POP' else 'NO_OP' end as op,
       greatest(depth, 0) as stack_depth,
       coalesce(lag(next_state) over (partition by id order by nth), 'Start') as current_state, next_state
from running left join bad using (id) where first_error is null or nth <= first_error""",
    "stack_trace_full": f"""with named as (
  select user_id || '|' || cast(ts as date) as id, {_DEFAULT_SYMBOL} as symbol,
         row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) - 1 as nth
  from events),
running as (
  select *, sum(case symbol when 'state=S0' then 1 when 'state=SF' then -1 else 0 end) over w as depth,
         case when symbol = 'proto=tcp' then 'TCP' when symbol = 'proto=udp' then 'UDP'
              when symbol like 'proto=%' then 'OTHER' end as switch
  from named window w as (partition by id order by nth)),
controlled as (
  select *, coalesce(last_value(switch ignore nulls) over (partition by id order by nth), 'Start') as next_state,
         coalesce(last_value(switch ignore nulls) over (partition by id order by nth
                  rows between unbounded preceding and 1 preceding), 'Start') as current_state from running),
ends as (select id, min(nth) filter (depth < 0) as first_error, last(depth order by nth) as final from running group by id)
select id, nth as step, symbol,
       case when depth < 0 then 'POP_ERROR' when symbol = 'state=S0' then 'PUSH' when symbol = 'state=SF' then 'POP' else 'NO_OP' end as op,
       array_to_string(list_transform(range(greatest(depth, 0)::bigint), lambda x: 'state=S0'), '|') as stack_after,
       current_state, next_state, first_error is null and final = 0 as ok
from controlled join ends using (id) where first_error is null or nth <= first_error""",
    "rule_conformance": f"{_SEARCH} select conv_id, accepted from best",
    "rule_best_attempt": f"""{_SEARCH}
select conv_id, accepted, case when consumed = 0 then '' else array_to_string(path, ',') end as path from best""",
    "rule_step_trace": f"""{_SEARCH}, found as (
  select conv_id, unnest(steps) as s, cast(generate_subscripts(steps, 1) - 1 as integer) as step
  from best where consumed > 0)
select conv_id, step, s.op as op, s.symbol as symbol, s.after as stack_after, s.a as current_state, s.b as next_state
from found""",
    "rule_unwinding": f"""{_search_sql(_UNWINDING_RULES)}
select conv_id, accepted, case when consumed = 0 then '' else array_to_string(path, ',') end as path from best""",
    "rule_table": f"""with labels as (select p_partkey as k, {LABEL_EXPR} as label from part),
cut as (
  select k, label, regexp_extract(label, '^([^,]*),(.*?)->(.*)$', ['a', 'b', 'c']) as p,
         label like '%,%' and label like '%->%' as fulls from labels),
parts as (
  select k,
         case when not fulls then label when p.c = '' and p.a = '' and position('->' in label) < position(',' in label)
              then trim(label[:position(',' in label) - 1]) else trim(p.a) end as input,
         case when not fulls then 'ε'
              when position('->' in label) < position(',' in label) then trim(label[position(',' in label) + 1:])
              else trim(p.b) end as pop,
         case when not fulls then 'ε' else trim(label[position('->' in label) + 2:]) end as push
  from cut)
select k, nullif(input, 'ε') as input, nullif(pop, 'ε') as pop,
       case when push = 'ε' then '' else array_to_string(list_filter(string_split_regex(push, '\\s+'), lambda x: x <> ''), '|') end as push
from parts""",
}
