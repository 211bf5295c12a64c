"""Deduplication, messages, streams, evaluation and export."""

import random

import pytest
from pyspark.sql import functions as F

from tailrace.operators import dedup, evaluation, export, messages, relational
from tailrace.sources import files
from tailrace.streaming import bus
from tailrace.taxonomy import LABELS

BUS = "event_id string, event_type string, version int, occurred_at timestamp, content_hash string, data string, source_id string, stream string, batch_no bigint, delivered_at timestamp"


def test_shingles(spark):
    def n(t, k):
        return spark.createDataFrame([(t,)], "t string").select(dedup.shingles(F.col("t"), k).alias("s")).head()["s"]

    assert len(n("a b c d e f g h i", 3)) == 7
    assert n("Hello  world", 5) == ["hello world"]
    assert n("", 5) == [""]


def test_signatures(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(200)]
    near = base[:100] + ["edit"] + base[101:]
    far = [rng.choice(words) for _ in range(200)]
    df = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, None), (5, " ".join(base))], "id long, body string")
    sig = dedup.signatures(df).cache()
    rows = {r["document_id"]: r for r in sig.collect()}
    assert len(rows[1]["hashvalues"]) == 128 and len(rows[1]["band_hashes"]) == 32 and rows[1]["band_hashes"][1].startswith("b1:")

    def sim(a, b):
        return sum(x == y for x, y in zip(rows[a]["hashvalues"], rows[b]["hashvalues"])) / 128

    assert sim(1, 5) == 1.0 and sim(1, 2) > 0.5 and sim(1, 3) < 0.5
    dup = {r["document_id"]: r["duplicate_of"] for r in dedup.near_duplicates(sig, df.select(F.col("id").alias("document_id"), F.col("id").alias("seq"))).collect()}
    assert dup[5] == 1 and 3 not in dup and 1 not in dup
    status = {r["document_id"]: r["status"] for r in dedup.dedup_status(df, spark.createDataFrame([(5, 1)], "document_id long, duplicate_of long")).collect()}
    assert status == {1: "deduped", 2: "deduped", 3: "deduped", 4: "failed", 5: "duplicate"}


def test_signature_similarity(spark):
    df = spark.createDataFrame([([1, 2], [1, 3]), ([1], [1, 2]), ([], [])], "a array<long>, b array<long>")
    assert [r[0] for r in df.select(dedup.signature_similarity(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0, 0.0]


def _bus(spark, tmp_path, rows, name="bus.parquet"):
    path = str(tmp_path / name)
    spark.createDataFrame(rows, BUS).repartition(3, "batch_no").write.parquet(path)
    return path


def _message(event_id, batch, delivered, data='{"source_id": "s"}', kind="ingest.requested"):
    import datetime as dt

    return (event_id, kind, 1, None, None, data, "s", kind, batch, delivered and dt.datetime(2024, 1, 1, 0, 0, delivered))


U = "0a95928c-abbb-4a87-a986-1382c45a79a1"


def test_exactly_once(spark, tmp_path):
    rows = [
        _message(U, 1, 5), _message("{" + U.upper() + "}", 2, 3), _message("urn:uuid:" + U, 3, None), _message(U.replace("-", "") + "\n", 4, 9), _message(None, 5, 1), _message(None, 6, 1), _message("  ", 7, 1), _message("plain", 8, 1), _message(" PLAIN", 9, 1),
    ]
    df = spark.read.parquet(_bus(spark, tmp_path, rows))
    for limit in (32 << 20, 0):
        got = sorted(r["batch_no"] for r in messages.exactly_once(df, limit=limit).collect())
        assert got == [2, 5, 6, 7, 8], limit
        again = [r["event_id"] for r in messages.repeated_messages(df, limit=limit).collect()]
        assert sorted(again) == sorted([U, "plain"]), limit
    counts = {r["key"]: r["n_deliveries"] for r in messages.deliveries(df).collect()}
    assert counts == {U: 4, "plain": 2}
    empty = spark.read.parquet(_bus(spark, tmp_path, [], "none.parquet"))
    assert messages.exactly_once(empty).isEmpty() and messages.repeated_messages(empty).isEmpty()


def test_exactly_once_keeps_clashing_columns(spark, tmp_path):
    path = str(tmp_path / "c.parquet")
    spark.createDataFrame([(U, None, 1, "f", 7, 1), (U, None, 2, "g", 8, 2)], "event_id string, delivered_at timestamp, batch_no bigint, file string, row int, key int").coalesce(1).write.parquet(path)
    got = messages.exactly_once(spark.read.parquet(path)).collect()
    assert len(got) == 1 and got[0]["file"] == "f" and got[0].asDict().keys() == {"event_id", "delivered_at", "batch_no", "file", "row", "key"}


def test_hot_message(spark, tmp_path):
    rows = [_message(U, i, 1) for i in range(300)] + [_message(f"x{i}", i, 1) for i in range(600)]
    df = spark.read.parquet(_bus(spark, tmp_path, rows))
    assert messages.exactly_once(df).count() == 601


def test_decode(spark):
    rows = [_message("1", 1, 1), _message("2", 1, 1, "{bad"), _message("3", 1, 1, "{}"), _message("4", 1, 1, '{"source_id": "s", "x": 1}'), _message("5", 1, 1, kind="odd"), _message("6", 1, 1, None), _message("7", 1, 1, "[1]"), _message("8", 1, 1, '{"source_id": null}')]
    got = {r["event_id"]: r["error"] for r in bus.decode(spark.createDataFrame(rows, BUS)).collect()}
    assert got == {"1": None, "2": "parse_error", "3": "missing_field", "4": "extra_field", "5": "unknown_type", "6": "parse_error", "7": "parse_error", "8": "missing_field"}


def test_backoff():
    assert [bus.backoff(n, lambda: 0.0) for n in (1, 2, 3)] == [1.0, 2.0, 4.0]


def test_stage_retries_and_dead_letters(spark, tmp_path):
    path = _bus(spark, tmp_path, [_message("1", 1, 1), _message("2", 1, 1, "{bad")])
    waits = []

    def fail(_):
        raise RuntimeError("no")

    bus.run_stage(bus.stream_of(spark, path), fail, f"{tmp_path}/out", f"{tmp_path}/dlq", f"{tmp_path}/cp", sleep=waits.append, jitter=lambda: 0.0)
    letters = {r["event_id"]: (r["error"], r["attempts"]) for r in spark.read.parquet(f"{tmp_path}/dlq").collect()}
    assert letters == {"1": ("RuntimeError", 3), "2": ("parse_error", 0)} and waits == [1.0, 2.0, 4.0]
    bus.run_stage(bus.stream_of(spark, path), lambda g: g.select("event_id"), f"{tmp_path}/out2", f"{tmp_path}/dlq2", f"{tmp_path}/cp2")
    assert [r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out2").collect()] == ["1"]
    assert bus.letter_depth(spark.read.parquet(f"{tmp_path}/dlq2")).head()["n"] == 1


def test_only_the_failing_message_is_a_dead_letter(spark, tmp_path):
    path = _bus(spark, tmp_path, [_message(str(i), i, 1) for i in range(9)])
    waits = []
    bus.run_stage(bus.stream_of(spark, path), lambda g: g.select(F.when(F.col("event_id") == "5", F.raise_error(F.lit("poison")).cast("string")).otherwise(F.col("event_id")).alias("event_id")), f"{tmp_path}/out", f"{tmp_path}/dlq", f"{tmp_path}/cp", max_retries=2, sleep=waits.append, jitter=lambda: 0.0)
    assert sorted(r["event_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [str(i) for i in range(9) if i != 5]
    assert [(r["event_id"], r["attempts"]) for r in spark.read.parquet(f"{tmp_path}/dlq").collect()] == [("5", 2)] and waits == [1.0, 2.0]


def test_stream_dedup_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(120)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:5])]
    for i in range(0, len(rows), 6):
        spark.createDataFrame(rows[i : i + 6], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    bus.dedup_stage(bus.stream_of(spark, f"{tmp_path}/docs", 1), f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r["document_id"] % 12, r["duplicate_of"] % 12) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(i, i) for i in range(5)}


def test_relational(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", 1, "y")], "k string, n int, v string")
    assert {(r["k"], r["n"]) for r in relational.latest_per_key(df, ["k"], [F.desc("n")]).collect()} == {("a", 2), ("b", 1)}
    new = spark.createDataFrame([("a", 0, "z")], df.schema)
    assert {(r["k"], r["v"]) for r in relational.upsert(df, new, ["k"], [F.desc("n")]).collect()} == {("a", "z"), ("b", "y")}
    assert relational.patch(df, new, "k", ["v"]).filter("k = 'a'").select("v").distinct().head()["v"] == "z"
    assert relational.delete_where(df, F.col("v") == "x").count() == 2


def _pred(spark, rows):
    return spark.createDataFrame([(i, LABELS[k], y, p) for i, k, y, p in rows], "example_id long, label string, y int, prob double")


def test_metrics(spark):
    perfect = _pred(spark, [(i, k, (i + k) % 2, float((i + k) % 2)) for i in range(6) for k in range(15)])
    r = evaluation.evaluate(perfect).head()
    assert r["micro_f1"] == 1.0 and r["macro_f1"] == 1.0 and r["ece"] == 0.0
    none = _pred(spark, [(i, 0, 1, 0.2) for i in range(4)])
    assert evaluation.micro_macro(none).head()["micro_f1"] == 0.0
    assert evaluation.ece(none).head()["ece"] == pytest.approx(0.8)


def test_thresholds(spark):
    rng = random.Random(1)
    rows = [(i, 0, y, round(0.6 * y + rng.random() * 0.39, 4)) for i in range(200) for y in [rng.randrange(2)]]
    r = evaluation.tune_thresholds(_pred(spark, rows)).head()
    assert r["f1"] == 1.0 and 0.1 <= r["threshold"] <= 0.9
    best = max((round(0.1 + 0.01 * k, 4) for k in range(81)), key=lambda t: (sum((p >= t) == (y == 1) for _, _, y, p in rows), -t))
    assert r["threshold"] == pytest.approx(best, abs=0.02)


def test_pos_weights(spark):
    df = spark.createDataFrame([(1, [1, 0, 0])] * 1 + [(i, [0, 1, 0]) for i in range(2, 101)], "example_id long, labels array<int>")
    w = {r["label_id"]: r["weight"] for r in evaluation.pos_weights(df).collect()}
    assert w[0] == 10.0 and w[2] == 10.0 and w[1] == pytest.approx(1 / 99)


def test_split(spark):
    df = spark.createDataFrame([(i, [int(i % 3 == 0), int(i % 5 == 0)]) for i in range(200)], "example_id long, labels array<int>")
    n = {r["split"]: r["count"] for r in evaluation.stratified_split(df).groupBy("split").count().collect()}
    assert sum(n.values()) == 200 and abs(n["val"] - 30) <= 4 and abs(n["test"] - 30) <= 4
    few = evaluation.stratified_split(df.limit(5))
    assert few.filter("split <> 'train'").isEmpty() and few.count() == 5


def test_merge(spark):
    texts = spark.createDataFrame([("a", "t"), ("b", " \n"), ("c", "t"), ("d", "t")], "id string, text string")
    labels = spark.createDataFrame([("a", "dns", "weak"), ("a", "bad-deploy", "human"), ("b", "dns", "weak"), ("c", "dns", "weak"), ("c", "__reviewed__", "human"), ("d", "odd", "human")], "incident_id string, label string, source string")
    got = {r["id"]: (r["labels"][LABELS.index("dns")], r["labels"][LABELS.index("bad-deploy")], r["weight"]) for r in evaluation.merge_silver_gold(texts, labels).collect()}
    assert got == {"a": (0, 1, 1.0), "c": (1, 0, 0.7)}


def test_export(spark, tmp_path):
    import datetime as dt

    schema = "id string, document_id string, org string, title string, url string, occurred_on date, severity smallint, summary string, sections array<struct<name:string,text:string>>, content_hash string, license string"
    rows = [("1", "d", "o", "t", None, dt.date(2024, 1, 2), 1, "full", [("Impact", "x")], "h2", "mit"), ("2", "e", "o", "t", "u", None, None, "hidden", None, "h1", "all-rights-reserved")]
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: r for r in export.export_rows(df).collect()}
    assert got["1"]["full_text"] == "full" and got["1"]["date"] == "2024-01-02" and got["1"]["sections"] == '[{"name":"Impact","text":"x"}]'
    assert got["2"]["full_text"] == "" and got["2"]["severity"] == -1 and got["2"]["sections"] == "[]" and len(got["1"]) == 10
    a = export.manifest(export.export_rows(df)).head()
    b = export.manifest(export.export_rows(df.orderBy(F.desc("id")).repartition(3))).head()
    assert a == b and a["num_records"] == 2
    export.write_export(df, str(tmp_path / "e"), 1)
    assert [r["content_hash"] for r in spark.read.parquet(str(tmp_path / "e")).collect()] == ["h1", "h2"]


def test_files(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "1", "text": "x", "silver_labels": ["dns"]}\nbroken\n{"id": "2"}\n')
    got = {r["id"]: r for r in files.read_training(spark, str(tmp_path / "t.jsonl")).collect()}
    assert got["1"]["silver_labels"] == ["dns"] and got["2"]["text"] == "" and got["2"]["gold_labels"] == [] and len(got) == 2
    g = spark.createDataFrame([("2", "h", ["b", "a"]), ("1", "g", [])], files.GOLDEN)
    files.write_golden(g, str(tmp_path / "g"))
    assert [(r["id"], r["labels"]) for r in files.read_golden(spark, str(tmp_path / "g")).orderBy("id").collect()] == [("1", []), ("2", ["a", "b"])]
    files.save_values(str(tmp_path / "v.json"), {"dns": 0.4})
    assert files.load_values(spark, str(tmp_path / "v.json")).head()["threshold"] == 0.4
    assert "| dns | 0.4000 |" in files.markdown_table("T", ["label", "threshold"], files.load_values(spark, str(tmp_path / "v.json")).collect())


def test_engine(spark, tmp_path):
    from tailrace.engine import DuplicateSource, Engine

    e = Engine(spark, str(tmp_path))
    s = e.create_source("a", "feed")
    with pytest.raises(DuplicateSource):
        e.create_source("a", "feed")
    d = e.discover(s, "https://x.example/1")
    assert e.discover(s, "https://x.example/1") == d and e.table("source_documents").count() == 1
    assert e.health() == {"spark": "ok", "tables": "ok"}


def test_engine_stages(spark, tmp_path):
    from tailrace.engine import Engine

    e = Engine(spark, str(tmp_path))
    rows = [("1", "s", "h", "Outage on 2024-01-02", "The disk was full and it was a total outage. More.", "https://blog.acme.com/x", "fetched", None, None, e.now), ("2", "s", "h", None, None, "https://x.org", "fetched", None, None, e.now)]
    e.append("source_documents", spark.createDataFrame(rows, e.table("source_documents").schema))
    out = e.process()
    r = out["incidents"].collect()
    assert len(r) == 1 and r[0]["org"] == "acme" and r[0]["severity"] == 0 and str(r[0]["occurred_on"]) == "2024-01-02"
