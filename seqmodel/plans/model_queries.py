"""Registered queries: profile, split, prefix tree, automaton, scoring, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmodel.operators import evaluate, given, profile, score
from seqmodel.operators.automaton import Model, state_name
from seqmodel.operators.prefix_tree import majority, prefix_nodes, ranked_votes, terminal_votes, with_prefix
from seqmodel.operators.split import SEED, TRAIN_RATIO, train_full, train_test_split
from seqmodel.plans import fixtures as fx
from seqmodel.plans import run
from seqmodel.plans.ingest_queries import INPUTS_SQL, inputs
from seqmodel.sources.scratch import written

# Scoring with symbols the model has never seen: it is trained on sessions without errors.
_TRAIN_EVENTS = "event_type <> 'error'"
_TRAIN_SYMBOLS = "symbol <> 'event=error'"
_START = "s1"


def _split(spark, d) -> tuple[DataFrame, DataFrame]:
    marked = train_test_split(_sequences(spark, d))
    return marked.filter("is_train"), marked.filter("not is_train")


def _sequences(spark, d) -> DataFrame:
    """Sessions, put together once."""
    return written(fx.sessions(spark, d), "sequences")


def _session_model(spark, d) -> Model:
    return Model.fit(fx.sessions(spark, d))


def _calm_model(spark, d) -> Model:
    return Model.fit(fx.sessions(spark, d, _TRAIN_SYMBOLS))


def _empty(seqs: DataFrame) -> DataFrame:
    return seqs.filter(F.size("symbols") < 0)


# Profile and split


def feature_summary(spark, d):
    return profile.feature_summary(fx.wide(spark, d))


def alphabet(spark, d):
    return profile.alphabet(_split(spark, d)[0])


def dataset_counts(spark, d):
    return profile.dataset_counts(
        train_test_split(written(inputs(spark, d), "sequences")), ["source", "is_train"]
    )


def split_query(spark, d):
    return train_test_split(_sequences(spark, d)).select("id", "is_train", "label")


def train_full_query(spark, d):
    return train_full(fx.records(spark, d)).groupBy("is_train", "label").agg(F.count(F.lit(1)).alias("n"))


# Prefix tree


def votes_query(spark, d):
    return terminal_votes(fx.sessions(spark, d)).select(fx.text().alias("symbols"), "pos", "neg")


def _nodes(seqs: DataFrame) -> DataFrame:
    """Nodes of the tree of ``seqs`` with their prefixes spelled out."""
    ranked = ranked_votes(written(terminal_votes(seqs), "votes"))
    return with_prefix(prefix_nodes(ranked), ranked)


def nodes_query(spark, d):
    return _nodes(fx.sessions(spark, d)).select(fx.text("prefix").alias("prefix"), "depth", "pos", "neg")


def edges_query(spark, d):
    parent = F.slice("prefix", F.lit(1), F.col("depth") - 1)
    return _nodes(fx.sessions(spark, d)).filter(F.col("depth") > 0).select(
        fx.text(parent).alias("parent"), "symbol", fx.text("prefix").alias("child")
    )


def root_query(spark, d):
    """Empty sequences vote at the root."""
    seqs = fx.wide(spark, d, fx.SPARSE_WIDE_EXPR, keep_empty=True)
    return _nodes(seqs).filter(F.col("depth") <= 1).select(fx.text("prefix").alias("prefix"), "pos", "neg")


# Automaton


def majority_vote(spark, d):
    return majority(terminal_votes(fx.records(spark, d))).select(
        fx.text().alias("symbols"), "pos", "neg", "accepting"
    )


def merge_states(spark, d):
    return _session_model(spark, d).named_prefixes().select(
        fx.text("prefix").alias("prefix"), state_name(F.col("state_id")).alias("state")
    )


def merged_states(spark, d):
    return _session_model(spark, d).states.select(
        state_name(F.col("state_id")).alias("state"), "pos", "neg", "accepting", "is_start", "is_sink"
    )


def state_numbering(spark, d):
    return _session_model(spark, d).named_states().select(
        "state_id", fx.text("rep_prefix").alias("rep_prefix")
    )


def _named(transitions: DataFrame) -> DataFrame:
    return transitions.select(
        state_name(F.col("state_id")).alias("state"), "symbol",
        state_name(F.col("next_state_id")).alias("next_state"),
    )


def merged_transitions(spark, d):
    return _named(_session_model(spark, d).transitions)


def complete_transitions(spark, d):
    return _named(_session_model(spark, d).complete_transitions())


def model_stats(spark, d):
    return _session_model(spark, d).stats()


def model_definition(spark, d):
    return Model.fit(fx.records(spark, d)).definition()


def grammar_rules(spark, d):
    return Model.fit(fx.records(spark, d)).grammar()


# Scoring


def classify(spark, d):
    train, test = _split(spark, d)
    return score.classify(test, Model.fit(train)).select("id", "label", "predicted")


def final_state(spark, d):
    train, test = _split(spark, d)
    return score.final_state(test, Model.fit(train)).select(
        "id", state_name(F.col("state_id")).alias("state")
    )


def classify_stay(spark, d):
    return score.classify_stay(_sequences(spark, d), _calm_model(spark, d)).select(
        "id", "final_state", "verdict"
    )


def classify_reason(spark, d):
    return score.classify_reason(_sequences(spark, d), _calm_model(spark, d)).select(
        "id", "accepted", "reason"
    )


def classify_from_state(spark, d):
    return score.classify_stay(_sequences(spark, d), _calm_model(spark, d), start=_START).select(
        "id", "final_state", "verdict"
    )


def state_trace(spark, d):
    train, test = _split(spark, d)
    return score.state_trace(test, Model.fit(train))


def rule_usage(spark, d):
    train, test = _split(spark, d)
    return score.rule_usage(terminal_votes(test), Model.fit(train))


def _histories(spark, d):
    """Whole histories of the users, and the arguments of a walk through the given automaton."""
    events = fx.table(spark, d, "events").select("user_id", "ts", "event_id", F.concat(F.lit("event="), "event_type").alias("name"))
    return events, ["user_id"], ["ts", "event_id"], F.col("name"), given.Given.of(*fx.given_tables(spark), fx.GIVEN_START)


def walk_given_model(spark, d):
    """Both ways of a symbol without a transition: where the walk ends, and why it fails."""
    stay = given.walk(*_histories(spark, d), given.STAY).select("user_id", "final_state", "verdict")
    return stay.join(given.walk(*_histories(spark, d), given.FAIL).select("user_id", "accepted", "reason"), "user_id")


def walk_given_trace(spark, d):
    return given.walk_trace(*_histories(spark, d))


# Evaluation


def confusion(spark, d):
    seqs = fx.records(spark, d)
    return evaluate.confusion(seqs, Model.fit(seqs))


def metrics(spark, d):
    marked = train_test_split(written(fx.records(spark, d), "sequences"))
    return evaluate.metrics(marked.filter("not is_train"), Model.fit(marked.filter("is_train")))


def metrics_empty(spark, d):
    seqs = fx.records(spark, d)
    return evaluate.metrics(_empty(seqs), Model.fit(seqs))


def holdout_report(spark, d):
    """English documents are the input, each other language is a holdout source."""
    docs = written(fx.labelled_documents(spark, d), "sequences")
    marked = train_test_split(docs.filter("source = 'en'"))
    model = Model.fit(marked.filter("is_train"))
    return evaluate.holdout_report(
        marked.filter("not is_train"), docs.filter("source <> 'en'"), model
    )


def run_summary(spark, d):
    docs = fx.labelled_documents(spark, d)
    return run.train_and_evaluate(docs.filter("source = 'en'"), docs.filter("source <> 'en'")).summary()


QUERIES = {
    "feature_summary": feature_summary,
    "alphabet": alphabet,
    "dataset_counts": dataset_counts,
    "train_test_split": split_query,
    "train_full": train_full_query,
    "terminal_votes": votes_query,
    "prefix_nodes": nodes_query,
    "prefix_edges": edges_query,
    "prefix_root": root_query,
    "majority_vote": majority_vote,
    "merge_states": merge_states,
    "merged_states": merged_states,
    "state_numbering": state_numbering,
    "merged_transitions": merged_transitions,
    "complete_transitions": complete_transitions,
    "model_stats": model_stats,
    "model_definition": model_definition,
    "grammar_rules": grammar_rules,
    "classify": classify,
    "final_state": final_state,
    "classify_stay": classify_stay,
    "classify_reason": classify_reason,
    "classify_from_state": classify_from_state,
    "state_trace": state_trace,
    "rule_usage": rule_usage,
    "walk_given_model": walk_given_model,
    "walk_given_trace": walk_given_trace,
    "confusion": confusion,
    "metrics": metrics,
    "metrics_empty": metrics_empty,
    "holdout_report": holdout_report,
    "run_summary": run_summary,
}


def split_sql(source: str = "seqs", name: str = "marked") -> str:
    """Rank by key; size truncated, moved off 0 and off n."""
    return f"""{name}_ranked as (
  select *, row_number() over (order by md5('{SEED}:' || id), id) as nth, count(*) over () as n from {source}),
{name} as (
  select * exclude (nth, n),
         nth <= case when floor(n * cast({TRAIN_RATIO} as double)) = 0 then 1
                     when floor(n * cast({TRAIN_RATIO} as double)) = n then n - 1
                     else floor(n * cast({TRAIN_RATIO} as double)) end as is_train
  from {name}_ranked)"""


def votes_sql(source: str = "seqs", where: str = "true") -> str:
    return f"""votes as (
  select symbols, count(*) filter (label) as pos, count(*) filter (not label) as neg
  from {source} where {where} group by symbols)"""


# Exact residual sets, where the Spark side keeps digests.
NODES_SQL = """steps as (
  select *, unnest(range(0, len(symbols) + 1)) as k from votes
  union all select cast([] as varchar[]), 0, 0, 0),
heads as (
  select symbols[1:k] as prefix, case when k = len(symbols) then pos else 0 end as pos,
         case when k = len(symbols) then neg else 0 end as neg,
         case when pos > neg then symbols[k + 1:] end as rest from steps),
nodes as (
  select prefix, len(prefix) as depth, cast(sum(pos) as bigint) as pos, cast(sum(neg) as bigint) as neg,
         coalesce(list(rest order by rest) filter (where rest is not null), []) as residual
  from heads group by prefix)"""

STATES_SQL = f"""{NODES_SQL},
known as (
  select *, false as sink from nodes
  union all
  select null, null, 0, 1, [], true where (select max(depth) from nodes) > 0),
blocks as (
  select residual, cast(sum(pos) as bigint) as pos, cast(sum(neg) as bigint) as neg,
         arg_min(prefix, {{'d': depth, 'p': prefix}}) filter (where prefix is not null) as rep,
         bool_or(sink) as is_sink from known group by residual),
states as (
  select *, row_number() over (order by coalesce(len(rep), 2147483647), rep) - 1 as state_id,
         pos > neg as accepting, coalesce(len(rep) = 0, false) as is_start from blocks),
prefix_state as (select prefix, state_id from nodes join states using (residual)),
sink as (select state_id as sink_id from states where is_sink)"""

TRANSITIONS_SQL = f"""{STATES_SQL},
transitions as (
  select distinct p.state_id, c.prefix[-1] as symbol, c.state_id as next_state_id
  from prefix_state c join prefix_state p on p.prefix = c.prefix[:-2] where len(c.prefix) > 0),
alphabet as (select distinct unnest(symbols) as symbol from votes),
complete as (
  select s.state_id, symbol, coalesce(next_state_id, (select sink_id from sink)) as next_state_id
  from states s cross join alphabet left join transitions using (state_id, symbol))"""

_SESSIONS = f"with {fx.sessions_sql()}, {votes_sql()}"
_TRAINED = f"with {fx.sessions_sql()}, {split_sql()}, {votes_sql('marked', 'is_train')}"
_CALM = f"with {fx.sessions_sql('calm', _TRAIN_EVENTS)}, {votes_sql('calm')}, {fx.sessions_sql()}, {TRANSITIONS_SQL}"
_RECORDS = f"with {fx.RECORDS_SQL}, {votes_sql('recs')}"

# Walking the complete automaton symbol by symbol, the independent way to score.
_WALK_STAY = """walk as (
  select id, symbols, 0 as i, (select state_id from states where {start}) as state_id from seqs
  union all
  select id, symbols, i + 1, coalesce(next_state_id, walk.state_id)
  from walk left join complete on complete.state_id = walk.state_id and symbol = symbols[i + 1]
  where i < len(symbols)),
ends as (select id, walk.state_id, accepting from walk join states using (state_id) where i = len(symbols))
select id, 's' || state_id as final_state, case when accepting then 'Malicious' else 'Benign' end as verdict
from ends"""

_CONFUSION = """scored as (
  select label, coalesce(pos > neg, false) as hit{by} from {test} left join votes using (symbols)),
counts as (
  select {group} count(*) filter (hit and label) as tp, count(*) filter (not hit and not label) as tn,
         count(*) filter (hit and not label) as fp, count(*) filter (not hit and label) as fn
  from scored {tail}),
rates as (
  select {group} tp + tn + fp + fn as test_size,
         case when tp + tn + fp + fn = 0 then 0.0::double else (tp + tn)::double / (tp + tn + fp + fn) end as accuracy,
         case when fp + tn = 0 then 0.0::double else fp::double / (fp + tn) end as false_positive_rate,
         case when fn + tp = 0 then 0.0::double else fn::double / (fn + tp) end as false_negative_rate
  from counts)"""


def confusion_sql(test: str, by: str = "") -> str:
    return _CONFUSION.format(
        test=test, by=f", {by}" if by else "", group=f"{by}," if by else "",
        tail=f"group by {by}" if by else "",
    )


_DOCS = f"""with {fx.LABELLED_SQL}, english as (select * from docs where source = 'en'), {split_sql('english')},
{votes_sql('marked', 'is_train')},
tests as (
  select 'combined_inputs' as source, symbols, label from marked where not is_train
  union all select source, symbols, label from docs where source <> 'en'),
{confusion_sql('tests', 'source')}"""

ORACLES = {
    "feature_summary": f"""with {fx.wide_sql()}, found as (select distinct unnest(symbols) as symbol from wide),
first as (select symbol from found order by symbol limit {profile.MAX_DISPLAY})
select (select count(*) from found) as unique_count,
       (select string_agg(symbol, ', ' order by symbol) from first) as sample_features,
       (select count(*) from found) > {profile.MAX_DISPLAY} as truncated""",
    "alphabet": f"""with {fx.sessions_sql()}, {split_sql()}
select distinct unnest(symbols) as symbol from marked where is_train""",
    "dataset_counts": f"""with {INPUTS_SQL}, {split_sql('inputs')}
select source, is_train, count(*) as n from marked group by all""",
    "train_test_split": f"with {fx.sessions_sql()}, {split_sql()} select id, is_train, label from marked",
    "train_full": f"with {fx.RECORDS_SQL} select true as is_train, label, count(*) as n from recs group by all",
    "terminal_votes": f"{_SESSIONS} select array_to_string(symbols, '|') as symbols, pos, neg from votes",
    "prefix_nodes": f"""{_SESSIONS}, {NODES_SQL}
select array_to_string(prefix, '|') as prefix, cast(depth as integer) as depth, pos, neg from nodes""",
    "prefix_edges": f"""{_SESSIONS}, {NODES_SQL}
select array_to_string(prefix[:-2], '|') as parent, prefix[-1] as symbol, array_to_string(prefix, '|') as child
from nodes where depth > 0""",
    "prefix_root": f"""with {fx.wide_sql(fx.SPARSE_WIDE_EXPR, keep_empty=True)}, {votes_sql('wide')}, {NODES_SQL}
select array_to_string(prefix, '|') as prefix, pos, neg from nodes where depth <= 1""",
    "majority_vote": f"""{_RECORDS}
select array_to_string(symbols, '|') as symbols, pos, neg, pos > neg as accepting from votes""",
    "merge_states": f"""{_SESSIONS}, {STATES_SQL}
select array_to_string(prefix, '|') as prefix, 's' || state_id as state from prefix_state""",
    "merged_states": f"""{_SESSIONS}, {STATES_SQL}
select 's' || state_id as state, pos, neg, accepting, is_start, is_sink from states""",
    "state_numbering": f"""{_SESSIONS}, {STATES_SQL}
select state_id, array_to_string(rep, '|') as rep_prefix from states""",
    "merged_transitions": f"""{_SESSIONS}, {TRANSITIONS_SQL}
select 's' || state_id as state, symbol, 's' || next_state_id as next_state from transitions""",
    "complete_transitions": f"""{_SESSIONS}, {TRANSITIONS_SQL}
select 's' || state_id as state, symbol, 's' || next_state_id as next_state from complete""",
    "model_stats": f"""{_SESSIONS}, {STATES_SQL}
select (select count(*) from nodes) + (select count(*) from sink) as states_before,
       (select count(*) from states) as states_after""",
    "model_definition": f"""{_RECORDS}, {TRANSITIONS_SQL}
select 'state' as part, 's' || state_id as item, '' as value from states
union all select 'alphabet', symbol, '' from alphabet
union all select 'start', 's' || state_id, '' from states where is_start
union all select 'accepting', 's' || state_id, '' from states where accepting
union all select 'sink', 's' || state_id, '' from states where is_sink
union all select 'transition', 's' || state_id || ' ' || symbol, 's' || next_state_id from complete""",
    "grammar_rules": f"""{_RECORDS}, {TRANSITIONS_SQL},
named as (select *, case when is_start then 'S' else 'A' || (state_id - 1) end as name from states)
select a.name as lhs, symbol as terminal, b.name as rhs
from complete c join named a on a.state_id = c.state_id join named b on b.state_id = c.next_state_id
union all
select a.name, symbol, ''
from complete c join named a on a.state_id = c.state_id join named b on b.state_id = c.next_state_id where b.accepting
union all select name, 'ε', '' from named where is_start and accepting""",
    "classify": f"""{_TRAINED}
select id, label, coalesce(pos > neg, false) as predicted
from marked left join votes using (symbols) where not is_train""",
    "final_state": f"""{_TRAINED}, {STATES_SQL}
select id, 's' || coalesce(state_id, (select sink_id from sink)) as state
from marked left join prefix_state on prefix = symbols where not is_train""",
    "classify_stay": f"{_CALM.replace('with', 'with recursive', 1)}, {_WALK_STAY.format(start='is_start')}",
    "classify_from_state": f"{_CALM.replace('with', 'with recursive', 1)}, {_WALK_STAY.format(start='state_id = 1')}",
    "classify_reason": f"""{_CALM.replace('with', 'with recursive', 1)},
walk as (
  select id, symbols, 0 as i, (select state_id from states where is_start) as state_id from seqs
  union all
  select id, symbols, i + 1, next_state_id
  from walk join complete on complete.state_id = walk.state_id and symbol = symbols[i + 1]
  where i < len(symbols)),
ends as (
  select id, max(i) as i, any_value(symbols) as symbols, arg_max(walk.state_id, i) as state_id from walk group by id)
select id, i = len(symbols) and accepting as accepted,
       case when i < len(symbols) then 'no transition on ''' || symbols[i + 1] || ''' from state ''s' || state_id ||
                                       ''' at position ' || i
            when accepting then 'accepted' else 'ended in non-accepting state ''s' || state_id || '''' end as reason
from ends join states using (state_id)""",
    "state_trace": f"""{_TRAINED.replace('with', 'with recursive', 1)}, {TRANSITIONS_SQL},
walk as (
  select id, symbols, 0 as i, null::bigint as from_id, (select state_id from states where is_start) as state_id
  from marked where not is_train
  union all
  select id, symbols, i + 1, walk.state_id, coalesce(next_state_id, (select sink_id from sink))
  from walk left join complete on complete.state_id = walk.state_id and symbol = symbols[i + 1]
  where i < len(symbols))
select id, i - 1 as step, 's' || from_id as current_state, symbols[i] as symbol, 's' || state_id as next_state
from walk where i > 0""",
    "rule_usage": f"""{_TRAINED.replace('with', 'with recursive', 1)}, {TRANSITIONS_SQL},
walk as (
  select label, symbols, 0 as i, null::bigint as from_id, (select state_id from states where is_start) as state_id
  from marked where not is_train
  union all
  select label, symbols, i + 1, walk.state_id, coalesce(next_state_id, (select sink_id from sink))
  from walk left join complete on complete.state_id = walk.state_id and symbol = symbols[i + 1]
  where i < len(symbols))
select 's' || from_id as current_state, symbols[i] as symbol, 's' || state_id as next_state,
       count(*) as uses, count(*) filter (label) as positive_uses
from walk where i > 0 group by all""",
    "walk_given_model": f"""with recursive {fx.GIVEN_SQL.format(on="true")},
{fx.GIVEN_SQL[fx.GIVEN_SQL.index("walk as"):].replace("walk", "strict").format(on="not w.lost")},
ends as (select user_id, state from walk join lengths using (user_id) where i = n),
last as (select user_id, max(i) as i, arg_max(state, i) as state, arg_max(symbol, i) as symbol, arg_max(lost, i) as lost
         from strict group by user_id)
select e.user_id, e.state as final_state, case when a.accepting then 'Malicious' else 'Benign' end as verdict,
       not l.lost and b.accepting as accepted,
       case when l.lost then 'no transition on ''' || l.symbol || ''' from state ''' || l.state || ''' at position ' || (l.i - 1)
            when b.accepting then 'accepted' else 'ended in non-accepting state ''' || l.state || '''' end as reason
from ends e join last l using (user_id)
join given_states a on a.state = e.state join given_states b on b.state = l.state""",
    "walk_given_trace": f"""with recursive {fx.GIVEN_SQL.format(on="true")}
select user_id, i - 1 as step, before as current_state, symbol, state as next_state from walk where i > 0""",
    "confusion": f"{_RECORDS}, {confusion_sql('recs')} select tp, tn, fp, fn from counts",
    "metrics": f"""with {fx.RECORDS_SQL}, {split_sql('recs')}, {votes_sql('marked', 'is_train')},
tests as (select * from marked where not is_train), {confusion_sql('tests')} select * from rates""",
    "metrics_empty": f"""{_RECORDS}, tests as (select * from recs where len(symbols) < 0),
{confusion_sql('tests')} select * from rates""",
    "holdout_report": f"{_DOCS} select * from rates",
    "run_summary": f"""{_DOCS}, {STATES_SQL}, found as (select distinct unnest(symbols) as symbol from english),
shown as (select symbol from found order by symbol limit {profile.MAX_DISPLAY})
select 'samples' as item, '' as source, (select count(*) from marked)::double as number, '' as note
union all select 'train', '', (select count(*) from marked where is_train), ''
union all select 'test', '', (select count(*) from marked where not is_train), ''
union all select 'features', '', (select count(*) from found), (select string_agg(symbol, ', ' order by symbol) from shown)
union all select 'features_truncated', '', ((select count(*) from found) > {profile.MAX_DISPLAY})::int, ''
union all select 'states_before', '', (select count(*) from nodes) + (select count(*) from sink), ''
union all select 'states_after', '', (select count(*) from states), ''
union all select 'test_size', source, test_size, '' from rates
union all select 'accuracy_percent', source, round(accuracy * 100, 4), '' from rates
union all select 'false_positive_percent', source, round(false_positive_rate * 100, 4), '' from rates
union all select 'false_negative_percent', source, round(false_negative_rate * 100, 4), '' from rates""",
}
