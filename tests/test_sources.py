"""Files in, sequences out; models to files and back."""

import pytest
from pyspark.sql import functions as F

from seqmodel.functions.text import NO_SYMBOL
from seqmodel.operators import score
from seqmodel.operators.automaton import Model
from seqmodel.sources.conn_log import numbered_lines, read_conn_log, read_lines
from seqmodel.sources.model_store import load_model, save_model
from seqmodel.sources.scratch import written
from seqmodel.sources.wide_table import read_wide_table


def write(folder, name, text):
    path = folder / name
    path.write_text(text, newline="")
    return str(path)


def symbols(df):
    return sorted((tuple(r.symbols), r.label) for r in df.collect())


def test_pipe_log(spark, tmp_path):
    head = "ts|uid|id.orig_h|id.resp_h|proto|service|conn_state|label"
    path = write(tmp_path, "a.log", "\n".join([
        "# first", "", head, "#comment", "1.5|C1|h|r|tcp|http|S0|Malicious", "",
        "2.5x|C2|h|r|tcp|-|SF|Benign", "short|row", "x|-|h|r|-||-|1|more|fields", head,
        'y|C4|h|r|"tcp|x"|"a ""b"""|S1|0',
    ]) + "\n")
    rows = read_conn_log(spark, [path])
    assert symbols(rows) == [
        (("proto=proto", "state=conn_state", "service=service"), False),
        (("proto=tcp", "state=S0", "service=http"), True),
        (("proto=tcp", "state=SF"), False),
        (("proto=tcp|x", "state=S1", 'service=a "b"'), False),
        ((NO_SYMBOL,), True),
    ]
    by_uid = {r.uid: r for r in rows.collect()}
    assert (by_uid["C1"].ts, by_uid["C2"].ts, by_uid["C4"].ts) == (1.5, 2.5, 0.0)
    assert by_uid["C1"].id == "C1" and len(by_uid["-"].id) == 64
    assert by_uid["C1"].source.endswith("a.log")


def test_files_with_other_headers(spark, tmp_path):
    paths = [
        write(tmp_path, "a.csv", "label,proto\r\nMALWARE,tcp\r\nmalicious,udp\r\n"),
        write(tmp_path, "b.csv", "label,proto\nbenign,icmp\n"),
        write(tmp_path, "c.csv", 'proto,label,label\ntcp,true,"no, Malice"\n'),
        write(tmp_path, "empty.csv", ""),
        write(tmp_path, "comments.csv", "#only\n#comments\n"),
    ]
    rows = read_conn_log(spark, paths)
    assert symbols(rows) == [
        (("proto=icmp",), False), (("proto=tcp",), True), (("proto=tcp",), True), (("proto=udp",), True),
    ]
    known = read_conn_log(spark, paths[:2], header="label,proto")
    assert known.count() == 3


def test_header_once_per_file_with_many_splits(spark, tmp_path):
    lines = [f"tcp,{i}" for i in range(3000)]
    path = write(tmp_path, "big.csv", "\n".join(["proto,label", *lines, "proto,label"]) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = read_lines(spark, [path])
        assert read.rdd.getNumPartitions() > 3
        assert read.count() == 3001
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ids_and_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    lines = [f"C{i % 700},p{i},true" for i in range(3000)]
    big = write(tmp_path, "big.csv", "\n".join(["#", "uid,proto,label", *lines]) + "\n")
    small = write(tmp_path, "small.csv", "uid,proto,label\nC1,q,true\n-,q,true\n-,q,true\n")
    name = "spark.sql.files.maxPartitionBytes"
    before, found, numbers = spark.conf.get(name), [], []
    try:
        for size in ("4096", "9000", before):
            spark.conf.set(name, size)
            rows = read_conn_log(spark, [big, small])
            found.append({r.id: r.symbols for r in rows.collect()})
            assert rows.count() == len(found[-1]) == 3003
            read = numbered_lines(read_lines(spark, [big, small])).collect()
            numbers.append({(r.source, r.line_no): r.value for r in read})
    finally:
        spark.conf.set(name, before)
    assert found[0] == found[1] == found[2] and numbers[0] == numbers[1] == numbers[2]
    assert found[0]["C5#2"] == ["proto=p705"] and found[0]["C1#6"] == ["proto=q"]
    by_line = {n: v for (source, n), v in numbers[0].items() if source.endswith("big.csv")}
    assert by_line == {i + 1: line for i, line in enumerate(lines)}


def test_missing_label_and_no_data(spark, tmp_path):
    with pytest.raises(ValueError, match="label"):
        read_conn_log(spark, [write(tmp_path, "a.csv", "proto,kind\ntcp,x\n")])
    with pytest.raises(ValueError, match="no sequences"):
        read_conn_log(spark, [write(tmp_path, "b.csv", "")])


def test_wide_table(spark, tmp_path):
    path = write(tmp_path, "w.csv", "\n".join([
        "hash,t_0,x,t_1,t_,malware,t_2", "#1,a,no,b,no,1,c", "h2,,no,b,no,0", "h3,,,,,1,", "h4,a,no", "",
    ]))
    rows = {r.id: (r.symbols, r.label) for r in read_wide_table(spark, [path]).collect()}
    assert rows == {"#1": (["a", "b", "c"], True), "h2": (["b"], False)}
    with pytest.raises(ValueError, match="malware"):
        read_wide_table(spark, [write(tmp_path, "x.csv", "hash,t_0\n1,a\n")])


def test_model_round_trip(spark, tmp_path):
    seqs = spark.createDataFrame(
        [(["a", "b"], True), (["c"], True), (["c"], False)], "symbols array<string>, label boolean"
    )
    model = Model.fit(seqs)
    save_model(model, str(tmp_path / "model"))
    loaded = load_model(spark, str(tmp_path / "model"))
    for name in ("votes", "states", "prefix_state", "transitions", "alphabet"):
        assert getattr(loaded, name).exceptAll(getattr(model, name)).count() == 0
        assert getattr(loaded, name).count() == getattr(model, name).count()
    assert loaded.sink_id == model.sink_id
    assert score.classify(seqs, loaded).filter("predicted").count() == 1


def test_stream_is_scored_like_a_batch(spark, tmp_path):
    from seqmodel.streaming.score import classify_stream

    seqs = spark.createDataFrame(
        [(["a", "b"], True), (["c"], False), (["a"], False), ([], False)], "symbols array<string>, label boolean"
    )
    model = Model.fit(seqs)
    seqs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(seqs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = classify_stream(stream, model).writeStream.format("memory").queryName("scored").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("scored").exceptAll(score.classify(seqs, model).select(spark.table("scored").columns)).count() == 0
    assert spark.table("scored").count() == 4
    with pytest.raises(ValueError, match="streaming"):
        classify_stream(seqs, model)


def test_written_tables_can_be_dropped(spark):
    from pathlib import Path

    from seqmodel.sources import scratch

    table = scratch.written(spark.range(3), "numbers", lookup=True)
    assert table.count() == 3
    mine, scratch._paths = scratch._paths[-1], scratch._paths[-1:]
    assert Path(mine.removeprefix("file:")).exists()
    scratch.drop_written(spark)
    assert not Path(mine.removeprefix("file:")).exists()


HEADER = "uid|proto|conn_state|service|label"


def log_file(folder, name, lines):
    (folder / name).write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    return str(folder / name)


def test_no_character_is_a_mark(spark, tmp_path):
    lines = ["a|tcp\u0001x|S0|dns|malicious", 'b|"t￿|p"|S0|-|Malicious', "c|t￿p|S0|-|benign"]
    rows = {r.id: r for r in read_conn_log(spark, [log_file(tmp_path, "x.log", lines)]).collect()}
    assert {i: r.label for i, r in rows.items()} == {"a": True, "b": True, "c": False}
    assert rows["a"].symbols[0] == "proto=tcp\u0001x" and rows["b"].symbols[0] == "proto=t￿|p"


def test_equal_lines_have_ids_of_their_own(spark, tmp_path):
    path = log_file(tmp_path, "x.log", ["-|tcp|S0|dns|benign"] * 3 + ["u|tcp|S0|dns|benign"] * 2)
    ids = [r.id for r in read_conn_log(spark, [path]).collect()]
    assert len(ids) == 5 and len(set(ids)) == 5 and {"u", "u#2"} <= set(ids)


def test_headers_without_lines_are_an_error(spark, tmp_path):
    paths = [log_file(tmp_path, "a.log", []), log_file(tmp_path, "b.log", ["# only a comment"])]
    with pytest.raises(ValueError, match="no sequences"):
        read_conn_log(spark, paths)
    with pytest.raises(ValueError, match="no sequences"):
        read_conn_log(spark, paths, header=HEADER)


def test_written_tables_leave_no_shuffle_files(spark):
    """They went only when the driver's heap was collected, so a pipeline held those of many steps at once."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {n for n in blocks.getAllFiles().mkString(" ").split() if n.endswith(".data")}
    before, was = names(), spark.conf.get(setting)
    table = written(spark.range(10_000).groupBy((F.col("id") * 7 % 5000).alias("k")).count(), "counted")
    assert names() <= before and spark.conf.get(setting) == was
    assert table.count() == 5000 and table.groupBy("count").count().collect() == [(2, 5000)]
