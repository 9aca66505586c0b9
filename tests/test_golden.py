"""Known languages and rule sets."""

import pytest
from pyspark.sql import functions as F

from seqmodel.operators import score, stack
from seqmodel.operators.automaton import Model
from seqmodel.operators.rules import RULE_TYPE, Rules, rule_attempts, rule_step_trace, rule_table

# The accepted sequences of a published connection-log model, and its symbols.
ACCEPTED = [("proto=tcp", f"state={s}") for s in "S0 OTH REJ S2 RSTRH S1 RSTR SF".split()] + [
    ("proto=tcp", "state=S1", "service=irc"),
    ("proto=tcp", "state=RSTR", "service=http"), ("proto=tcp", "state=RSTR", "service=irc"),
    ("proto=tcp", "state=SF", "service=http"), ("proto=tcp", "state=SF", "service=ssh"),
    ("proto=tcp", "state=SF", "service=irc"),
    ("proto=tcp", "state=RSTO", "service=http"), ("proto=tcp", "state=S3", "service=irc"),
]
SYMBOLS = (
    "proto=icmp proto=tcp proto=udp service=dhcp service=dns service=http service=irc service=ssh "
    "service=ssl state=OTH state=REJ state=RSTO state=RSTOS0 state=RSTR state=RSTRH state=S0 state=S1 "
    "state=S2 state=S3 state=SF state=SH state=SHR"
).split()

# A published connection rule set as (state, label, next state).
CONNECTION_RULES = [
    ("__start", "ε, ε -> Z0", "Start"),
    ("Start", "proto=tcp, ε -> ε", "TCP_Pending"),
    ("Start", "proto=udp, ε -> ε", "UDP_Process"),
    ("Start", "proto=icmp, ε -> ε", "ICMP_Process"),
    ("TCP_Pending", "state=S0, ε -> CONN", "TCP_Established"),
    ("TCP_Pending", "service=http, ε -> ε", "TCP_Pending"),
    ("TCP_Pending", "service=ssh, ε -> ε", "TCP_Pending"),
    ("TCP_Pending", "state=S1, ε -> ε", "Reject"),
    ("TCP_Pending", "state=SF, ε -> ε", "Reject"),
    ("TCP_Established", "state=S1, ε -> ε", "TCP_Established"),
    ("TCP_Established", "state=S2, ε -> ε", "TCP_Established"),
    ("TCP_Established", "service=http, ε -> ε", "TCP_Established"),
    ("TCP_Established", "service=ssh, ε -> ε", "TCP_Established"),
    ("TCP_Established", "proto=tcp, ε -> ε", "TCP_Established"),
    ("TCP_Established", "state=SF, CONN -> ε", "TCP_Closing"),
    ("TCP_Established", "state=RSTR, CONN -> ε", "TCP_Closing"),
    ("TCP_Closing", "END, Z0 -> ε", "Accept"),
    ("TCP_Established", "END, CONN -> CONN", "Reject"),
    ("UDP_Process", "service=dns, ε -> ε", "UDP_Process"),
    ("UDP_Process", "service=ntp, ε -> ε", "UDP_Process"),
    ("UDP_Process", "proto=udp, ε -> ε", "UDP_Process"),
    ("UDP_Process", "state=OTH, ε -> ε", "UDP_Process"),
    ("UDP_Process", "END, Z0 -> ε", "Accept"),
    ("ICMP_Process", "type=echo, ε -> ε", "ICMP_Process"),
    ("ICMP_Process", "proto=icmp, ε -> ε", "ICMP_Process"),
    ("ICMP_Process", "state=OTH, ε -> ε", "ICMP_Process"),
    ("ICMP_Process", "END, Z0 -> ε", "Accept"),
]


@pytest.fixture(scope="module")
def model(spark):
    rows = [(list(s), True) for s in ACCEPTED] + [([s], False) for s in SYMBOLS]
    return Model.fit(spark.createDataFrame(rows, "symbols array<string>, label boolean"))


def test_published_language_has_nine_states(model):
    assert model.states.count() == 9
    assert model.alphabet.count() == 22
    assert model.complete_transitions().count() == 9 * 22
    flags = model.states.agg(F.count_if("is_start"), F.count_if("is_sink")).first()
    assert tuple(flags) == (1, 1)


def test_language_is_kept(spark, model):
    other = [("proto=udp",), ("proto=tcp",), ("proto=tcp", "state=RSTO"), ("state=S0",), (),
             ("proto=tcp", "state=S0", "service=http"), ("new",), ("new", "proto=tcp", "state=S0")]
    rows = [(list(s), s in ACCEPTED) for s in ACCEPTED + other]
    seqs = spark.createDataFrame(rows, "symbols array<string>, label boolean")
    assert score.classify(seqs, model).filter("predicted <> label").count() == 0
    stay = {tuple(r.symbols): r.verdict for r in score.classify_stay(seqs, model).collect()}
    assert stay[("new", "proto=tcp", "state=S0")] == "Malicious"
    assert stay[("new",)] == "Benign"


def test_reason_texts(spark, model):
    seqs = spark.createDataFrame(
        [(["proto=tcp", "new"],), (["proto=tcp", "state=S0"],), ([],)], "symbols array<string>"
    )
    reasons = {tuple(r.symbols): r.reason for r in score.classify_reason(seqs, model).collect()}
    state = score.final_state(
        spark.createDataFrame([(["proto=tcp"],)], "symbols array<string>"), model
    ).first()["state_id"]
    assert reasons[("proto=tcp", "new")] == f"no transition on 'new' from state 's{state}' at position 1"
    assert reasons[("proto=tcp", "state=S0")] == "accepted"
    assert reasons[()] == "ended in non-accepting state 's0'"


def test_unknown_start_state(spark, model):
    seqs = spark.createDataFrame([(["proto=tcp"],)], "symbols array<string>")
    for name in ("s99", "x", "s01", ""):
        with pytest.raises(ValueError, match="unknown state"):
            score.classify_stay(seqs, model, start=name)
    sink = model.sink_id
    assert score.classify_stay(seqs, model, start=f"s{sink}").first()["final_state"] == f"s{sink}"


def test_model_without_symbols_has_no_sink(spark):
    empty = spark.createDataFrame([([], True)], "symbols array<string>, label boolean")
    model = Model.fit(empty)
    row = model.states.first()
    assert (model.states.count(), row.accepting, model.sink_id) == (1, True, None)
    assert model.complete_transitions().count() == 0
    other = spark.createDataFrame([(["a"],)], "symbols array<string>")
    assert score.final_state(other, model).first()["state_id"] is None
    assert model.stats().first().asDict() == {"states_before": 1, "states_after": 1}


def test_merged_counts_include_the_sink(spark):
    seqs = spark.createDataFrame(
        [(["a"], True), (["a"], True), (["a"], False), (["b"], False)], "symbols array<string>, label boolean"
    )
    rows = Model.fit(seqs).named_states().orderBy("state_id").collect()
    assert [(r.rep_prefix, r.pos, r.neg, r.accepting, r.is_sink) for r in rows] == [
        ([], 0, 0, False, False), (["a"], 2, 1, True, False), (["b"], 0, 2, False, True),
    ]


def connection_rules(spark):
    rows = [(i, *r) for i, r in enumerate(CONNECTION_RULES)]
    table = spark.createDataFrame(rows, "rule_no int, state string, label string, next_state string")
    return Rules.of(rule_table(table, "label"), "__start", ["Accept"])


def events(spark, texts):
    rows = [(key, i, s) for key, text in texts.items() for i, s in enumerate(text.split())]
    return spark.createDataFrame(rows, "id string, i int, symbol string")


@pytest.mark.parametrize("chunk_events", [100, 1])
def test_connection_rules(spark, chunk_events):
    texts = {
        "a": "proto=tcp state=S0 state=SF END", "b": "proto=udp service=dns END",
        "c": "proto=tcp state=S1 END", "d": "proto=tcp state=S0 END", "e": "nothing here",
    }
    rules = connection_rules(spark)
    found = rule_attempts(events(spark, texts), "id", ["i"], "symbol", rules, chunk_events=chunk_events)
    rows = {r.id: r for r in found.collect()}
    assert {k: r.accepted for k, r in rows.items()} == {
        "a": True, "b": True, "c": False, "d": False, "e": False
    }
    steps = rule_step_trace(found, "id", rules).filter("id = 'a'").orderBy("step").collect()
    assert [(s.op, s.symbol, s.stack_after) for s in steps] == [
        ("PUSH", "ε", ["Z0"]), ("NO_OP", "proto=tcp", ["Z0"]), ("PUSH", "state=S0", ["Z0", "CONN"]),
        ("POP", "state=SF", ["Z0"]), ("POP", "END", []),
    ]
    assert rows["e"].path == []
    assert len(rows["d"].path) == 4 and len(rows["c"].path) == 3


def test_stack_texts(spark):
    texts = {
        "a": "proto=tcp state=S0 state=SF", "b": "proto=udp state=SF state=S0",
        "c": "x state=S0 state=S0 proto=icmp state=SF",
    }
    rows = events(spark, texts)
    balance = {r.id: (r.ok, r.reason) for r in stack.stack_balance(rows, ["id"], ["i"]).collect()}
    assert balance == {
        "a": (True, "accepted"),
        "b": (False, "pop without matching push at position 1"),
        "c": (False, "final stack not empty (1 unmatched pushes)"),
    }
    trace = stack.stack_trace(rows, ["id"], ["i"]).orderBy("id", "step")
    trace = trace.withColumn("after", F.array_join(stack.stack_after(F.col("stack_depth")), " "))
    assert [(r.id, r.op, r.after, r.current_state, r.next_state) for r in trace.collect()] == [
        ("a", "NO_OP", "", "Start", "TCP"), ("a", "PUSH", "state=S0", "TCP", "TCP"),
        ("a", "POP", "", "TCP", "TCP"),
        ("b", "NO_OP", "", "Start", "UDP"), ("b", "POP_ERROR", "", "UDP", "UDP"),
        ("c", "NO_OP", "", "Start", "Start"), ("c", "PUSH", "state=S0", "Start", "Start"),
        ("c", "PUSH", "state=S0 state=S0", "Start", "Start"),
        ("c", "NO_OP", "state=S0 state=S0", "Start", "OTHER"), ("c", "POP", "state=S0", "OTHER", "OTHER"),
    ]
