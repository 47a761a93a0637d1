import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import dataset, facts, graph
from tracewright.sources import files, logs
from tracewright.streaming import tail


def write(path, text):
    path.write_bytes(text.encode() if isinstance(text, str) else text)
    return str(path)


def test_jsonl_lines(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '﻿{"a":1}\n\n {"a":2}\r\n')
    assert [(r.line, r.text.strip()) for r in files.read_jsonl(spark, p).orderBy("line").collect()] == [(1, '{"a":1}'), (3, '{"a":2}')]
    for bad in ('{"a":1}\n{oops\n', "[1]\n"):
        with pytest.raises(Exception, match="JSON"):
            files.read_jsonl(spark, write(tmp_path / "b.jsonl", bad)).collect()


def test_requests_and_facts(spark, tmp_path):
    row = {"scenario_id": "s", "contact_id": 7, "observation_time": "t", "hypothesis": "h"}
    p = write(tmp_path / "r.jsonl", json.dumps(row))
    assert tuple(files.read_feature_requests(spark, p).first()) == ("s", "7", "t", "h")
    with pytest.raises(Exception, match="contact_id is missing in line 1"):
        files.read_feature_requests(spark, write(tmp_path / "r2.jsonl", json.dumps(row | {"contact_id": 0}))).collect()
    with pytest.raises(ValueError):
        files.read_feature_requests(spark, write(tmp_path / "r3.jsonl", "\n"))
    f = {"subject": "a", "predicate": "B", "object": "c", "source_id": "d", "source_type": "e", "locator": "f", "confidence": 7}
    r = files.read_facts(spark, write(tmp_path / "f.jsonl", json.dumps(f))).first()
    assert (r.confidence, r.evidence) == (7.0, "")


def test_examples_and_models(spark, tmp_path):
    rows = [{"scores": {"b": "1.5", "a": 2}, "truth": "a"}, {"scores": {"a": 0, "b": 1}, "truth": "b"}]
    classes, df = files.read_examples(spark, write(tmp_path / "e.jsonl", "\n".join(map(json.dumps, rows))))
    assert classes == ["a", "b"] and sorted((r.logits, r.label) for r in df.collect()) == [([0.0, 1.0], 1), ([2.0, 1.5], 0)]
    for bad in ([rows[0], {"scores": {"a": 1}, "truth": "a"}], [{"scores": {"a": 1, "b": 2}, "truth": "z"}]):
        with pytest.raises(ValueError):
            files.read_examples(spark, write(tmp_path / "e2.jsonl", "\n".join(map(json.dumps, bad))))
    model = {"method": "temperature_scaling", "classes": ["a"], "temperature": 2.0}
    files.write_model(model, str(tmp_path / "m.json"))
    assert files.read_model(str(tmp_path / "m.json")) == model
    for key, value in (("method", "x"), ("classes", [1]), ("temperature", "2")):
        files.write_model(model | {key: value}, str(tmp_path / "m2.json"))
        with pytest.raises(ValueError):
            files.read_model(str(tmp_path / "m2.json"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, None, ("y", 1))], "b int, a string, c struct<z:string,y:int>")
    files.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()[0] == '{"a":null,"b":2,"c":{"y":1,"z":"y"}}'


def test_log_objects():
    line = 'x {"a":"} {\\" "} y {"b":{"c":1}} z {"open":'
    assert logs.objects_in_line(line) == ['{"a":"} {\\" "}', '{"b":{"c":1}}']
    assert logs.objects_in_line('say "hi {"a":1}') == ['{"a":1}']
    assert logs.objects_in_reply('say "hi {"a":1}') == []
    assert logs.objects_in_reply('} {"a":1} {') == ['{"a":1}']


def test_recovery(spark):
    a = '{"b":1,"source":"cmo_lua","a":"x } y"}'
    rows = [(1, f"[12:00] {a} trailing"), (2, '{"source":"cmo_lua","a":"x } y","b":1}'), (3, '{"source":"else"} {"export_schema":"cmo_combat_id_v1"}'), (4, "{bad}")]
    df = spark.createDataFrame(rows, "line long, text string")
    assert [r.line for r in logs.recover_records(df).orderBy("line").collect()] == [1, 2, 3]
    got = logs.recover_records(df, unique=True).orderBy("line").collect()
    assert [(r.line, r.canonical) for r in got] == [(1, '{"a":"x } y","b":1,"source":"cmo_lua"}'), (3, '{"export_schema":"cmo_combat_id_v1"}')]


def test_positional(spark):
    df = spark.createDataFrame([("a PY_CONTACT_LOG,1,PY_CONTACT_LOG,2,3",), ("none",), ("PY_CONTACT_LOG key : v",)], "t string")
    assert [r[0] for r in df.select(logs.positional(F.col("t"))).collect()] == [["2", "3"], None, ["PY_CONTACT_LOG key : v"]]


def records(spark, *rows):
    df = spark.createDataFrame([("f", i + 1, json.dumps(r)) for i, r in enumerate(rows)], "path string, line int, text string")
    return df.withColumn("record", F.parse_json("text"))


def test_examples(spark):
    got = dataset.build_examples(records(spark, {"guid": "g1", "posture": "Hostile", "speed_kts": "12", "name": " n "}, {"actual_side": "Blue Force", "latitude": 1, "longitude": "2"}, {"posture": "Unknown", "actual_side": "Blue"}, {"posture": "unknown", "side": "Red"})).orderBy("source_line").collect()
    assert [r.label for r in got] == ["hostile", "blue_force", "unknown", "red"]
    assert got[0].id == "g1" and got[0].name == "n" and got[0].features.has_kinematics and not got[0].features.has_position
    assert got[1].features.has_position and got[1].features.speed_kts is None and len(got[1].id) == 16
    import hashlib

    assert got[2].id == hashlib.sha1(b'f:3:{"actual_side": "Blue", "posture": "Unknown"}').hexdigest()[:16]


def test_splits(spark, tmp_path):
    ex = dataset.build_examples(records(spark, *({"guid": str(i), "posture": "ab"[i % 2]} for i in range(50))))
    sizes = {r.split: r.n for r in dataset.split_sizes(dataset.split_by_hash(ex, "id", 0.7, 0.15, 1)).collect()}
    assert sizes == {"train": 35, "val": 7, "test": 8}
    one = dataset.split_by_hash(ex.limit(1), "id", 0.7, 0.15, 1).first()
    assert one.split == "test"
    assert {r.label: r["index"] for r in dataset.label_map(ex).collect()} == {"a": 0, "b": 1}
    import random

    order = list(range(50))
    random.Random(3).shuffle(order)
    split = dataset.split_by_shuffle(ex.withColumn("k", F.col("source_line").cast("long") - 1), "k", 50, 0.7, 0.15, 3)
    assert {r.k for r in split.filter("split = 'train'").collect()} == set(order[:35])
    with pytest.raises(ValueError):
        dataset.split_by_hash(ex, "id", 0.7, 0.3, 1)
    with pytest.raises(ValueError):
        dataset.drop_unknown(ex.withColumn("label", F.lit("unknown")))
    files.write_dataset(split.drop("k"), str(tmp_path / "d"), dataset.manifest(sizes, 2, ["f"], dataset.LABEL_FIELDS), {"a": 0, "b": 1})
    assert spark.read.text(str(tmp_path / "d/examples/split=test")).count() == 8
    assert len(spark.read.csv(str(tmp_path / "d/all_examples"), header=True).columns) == 21
    assert json.loads(spark.read.text(str(tmp_path / "d/manifest")).first()[0])["num_examples"] == 50


def test_split_of_copies(spark):
    """Rows of one id are dealt out by what they hold, whatever their order."""
    rows = spark.range(20).select(F.lit("a").alias("id"), F.col("id").alias("x"))
    parts = [{(r.x, r.split) for r in dataset.split_by_hash(df, "id", 0.7, 0.15, 1).collect()} for df in (rows, rows.orderBy(F.desc("x")))]
    assert parts[0] == parts[1] and len(parts[0]) == 20
    assert sorted(s for _, s in parts[0]) == ["test"] * 3 + ["train"] * 14 + ["val"] * 3


def test_chunks(spark):
    df = spark.createDataFrame([("abcdefghij",), ("",), (None,), ("ab  c",)], "text string")
    got = [(r.text, r.chunk_index, r.chunk) for r in facts.explode_chunks(df, 6, 2).collect()]
    assert got == [("abcdefghij", 0, "abcdef"), ("abcdefghij", 1, "efghij"), ("ab  c", 0, "ab c")]
    with pytest.raises(ValueError):
        facts.chunks(F.col("text"), 5, 5)


def test_html():
    html = "<html><title>T &amp; U</title><script>x<y</script><h1>Head</h1><p>one<sup>1</sup> <b>two</b></p><table><tr><td>no</td></tr></table><li>three"
    assert facts.text_of_html(html) == "T & U \n Head \n\n one two \n\n three"
    assert facts.text_of_html(None) == ""


REPLIES = [
    ('{"facts":[]}', []),
    ('<think>{"facts":[{"subject":"no","object":"no"}]}</think> ```json\n{"facts":[{"subject":" a ","predicate":"detects aircraft","object":"b","confidence":1.5}]}\n``` x', [("a", "DETECTS_AIRCRAFT", "b", 1.0)]),
    ('{"note":1} {"facts":[{"subject":"a","object":"b"},{"subject":"","object":"b"},3,{"subject":null,"predicate":"--","object":2,"confidence":"0.25"},{"subject":"a","object":"b","confidence":"high"}]}', [("a", "RELATED_TO", "b", 0.0), ("None", "RELATED_TO", "2", 0.25)]),
    ("no json", []),
    ('{"facts":[{"subject":"a"', []),
    (None, []),
]


def test_replies(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "k int, reply string")
    got = facts.normalise_facts(facts.facts_payload(df, ["k"]), ["k"]).collect()
    for i, (_, want) in enumerate(REPLIES):
        assert sorted((r.subject, r.predicate, r.object, r.confidence) for r in got if r.k == i) == sorted(want), i


def test_reply_counts(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "k int, reply string")
    assert facts.extraction_counts(df, ["k"]).first().asDict() == {"replies": 6, "blank": 1, "with_object": 3, "items": 6, "facts": 3, "left_out": 3}


def test_prompt_names_the_graphs_relations(spark):
    prompt = spark.range(1).select(facts.extraction_prompt(F.lit("T"), F.lit("web"), F.lit("http://x"), F.lit("{chunk}"))).first()[0]
    assert all(p in prompt for p in graph.TYPED)
    assert prompt.endswith("Source title: T\nSource type: web\nSource locator: http://x\n\nText chunk:\n{chunk}")


def test_fact_pipeline(spark):
    pages = spark.createDataFrame([("http://x/Big_Radar/", "<title>Radar - Wikipedia</title><p>text</p>"), ("http://x/Big_Radar/", "")], "url string, html string")
    docs = files.read_pages(pages)
    assert sorted(r.title for r in docs.collect()) == ["Big Radar", "Radar"]
    docs = docs.limit(1).withColumn("text", facts.html_text(F.col("html")))
    echo = lambda prompts: ['{"facts":[{"subject":"s","predicate":"p","object":"o"}]}' if "Text chunk" in p else "" for p in prompts]
    got = facts.extract_facts(docs, echo, 100, 10).collect()
    assert all((r.subject, r.chunk_index) == ("s", 0) for r in got)
    r = spark.range(1).select(facts.completion_text(F.lit(" "), F.lit("m"), F.lit("t")), facts.completion_text(F.lit(None).cast("string"), F.lit(""), F.lit(" "))).first()
    assert list(r) == ["m", ""]


def test_tail(spark, tmp_path):
    log, out, ck = tmp_path / "log", str(tmp_path / "out"), str(tmp_path / "ck")
    log.write_bytes(b"one\ntwo\nhalf")

    def run():
        q = tail.write_append(tail.tail(spark, str(log)), out, ck, every="0 seconds")
        q.processAllAvailable()
        q.stop()
        return sorted((r.line, r.text) for r in spark.read.parquet(out).collect())

    assert run() == [(1, "one"), (2, "two")]
    with log.open("ab") as f:
        f.write(b" line\r\n\xff\n")
    assert run() == [(1, "one"), (2, "two"), (3, "half line"), (4, "�")]
    assert tail._Reader({"path": str(log), "startingOffsets": "latest"}).initialOffset() == {"byte": log.stat().st_size, "line": 4}
    seen = []
    q = tail.write_numbered(tail.tail(spark, str(log)), lambda df, n: seen.append((n, df.count())), str(tmp_path / "ck2"))
    q.processAllAvailable()
    q.stop()
    assert seen[0] == (0, 4)


def test_windows(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", "2024-01-01 00:20:00", 2.0), ("a", "2024-01-01 01:00:00", 4.0)], "k string, t string, value double").withColumn("t", F.col("t").cast("timestamp"))
    assert sorted((r.n, r.total) for r in tail.tumbling_counts(df, "t", ["k"], "1 hour").collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in tail.session_counts(df, "t", ["k"], "30 minutes").collect()) == [1, 2]
