"""Numbers known beforehand for the tables of sf0.01."""

from pyspark.sql import functions as F

from seqmodel.operators.rules import rule_attempts
from seqmodel.plans import fixtures as fx
from seqmodel.plans.registry import QUERIES
from seqmodel.plans.stack_queries import TURN_RULES

SF_DIR = "/root/testdata/sf0.01"


def run(spark, name):
    return QUERIES[name](spark, SF_DIR)


def test_states_before_and_after(spark):
    assert run(spark, "model_stats").first().asDict() == {"states_before": 1115, "states_after": 271}


def test_split_size(spark):
    counts = run(spark, "train_test_split").groupBy("is_train").agg(F.count_if("label"), F.count("id"))
    rows = {r[0]: (r[1], r[2]) for r in counts.collect()}
    assert rows[True] == (1522, 2804) and rows[False][1] == 1202


def test_confusion(spark):
    assert run(spark, "confusion").first().asDict() == {"tp": 3997, "tn": 3892, "fp": 3560, "fn": 3551}


def test_stack_verdicts(spark):
    kinds = run(spark, "stack_balance").groupBy(F.substring("reason", 1, 5).alias("k")).count()
    assert {r.k: r["count"] for r in kinds.collect()} == {"pop w": 1338, "final": 1133, "accep": 1535}


def test_rule_verdicts_do_not_depend_on_chunks(spark):
    assert run(spark, "rule_conformance").filter("accepted").count() == 54
    turns = fx.turns(spark, SF_DIR)
    cut = rule_attempts(turns, "conv_id", ["turn"], "symbol", TURN_RULES, end=fx.TURN_END, chunk_events=3)
    whole = rule_attempts(turns, "conv_id", ["turn"], "symbol", TURN_RULES, end=fx.TURN_END)
    assert cut.exceptAll(whole).count() == 0 and cut.count() == whole.count() == 100
