"""Queries over the event bus: decoding, dead letters, and whole stages run as streams until their input is worked off."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tailrace.functions import text
from tailrace.operators import documents as ops
from tailrace.operators.messages import message_key
from tailrace.plans.copies import DUP
from tailrace.plans import texts as _texts  # noqa: F401
from tailrace.plans.core import P4_KEY, SQL, query, table
from tailrace.session import work_dir
from tailrace.streaming import bus

_OWN = {n: [k for k in {**bus.ENVELOPE, **own}] for n, own in bus.EVENTS.items()}
_MUST = {n: [k for k, (_, must) in own.items() if must] for n, own in bus.EVENTS.items()}


def _list(xs):
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


ERROR = "CASE WHEN NOT json_valid(data) OR data IS NULL OR json_type(data) <> 'OBJECT' THEN 'parse_error' " + f"WHEN event_type IS NULL OR event_type NOT IN ({', '.join(repr(n) for n in bus.EVENTS)}) THEN 'unknown_type' WHEN coalesce(version, -1) <> 1 THEN 'unknown_version' "
for _n in bus.EVENTS:
    _miss = " OR ".join(f"coalesce(json_extract_string(data, '$.{k}'), '') = ''" for k in _MUST[_n])
    ERROR += f"WHEN event_type = '{_n}' AND ({_miss}) THEN 'missing_field' WHEN event_type = '{_n}' AND len(list_filter(json_keys(data), lambda k: NOT list_contains({_list(_OWN[_n])}, k))) > 0 THEN 'extra_field' "
ERROR += "END"

#: Broken payloads don't occur in the table: some messages are spoilt by their batch number, in the query and in its SQL alike.
SPOILT = "CASE CAST(batch_no % 11 AS INT) WHEN 3 THEN substr(data, 1, 40) WHEN 5 THEN replace(data, 'document_id', 'documentid') WHEN 7 THEN replace(data, '\"version\": 1', '\"version\": 1, \"extra\": true') ELSE data END"
SPOILT_SQL = f"bad AS (SELECT * REPLACE ({SPOILT} AS data) FROM bus_events), dec AS (SELECT *, {ERROR} AS error FROM bad)"


def _spoilt(messages):
    return messages.withColumn("data", F.expr(SPOILT))


def _folder(spark, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {SPOILT_SQL} SELECT event_type, coalesce(error, 'ok') AS outcome, count(*) AS n FROM dec GROUP BY ALL")
def decode_events(spark, d):
    return bus.decode(_spoilt(table(spark, d, "bus_events"))).groupBy("event_type", F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {SPOILT_SQL} SELECT stream AS origin_stream, count(*) AS n FROM dec WHERE error IS NOT NULL GROUP BY stream")
def dlq_depth(spark, d):
    return bus.letter_depth(bus.dead_letters(bus.decode(_spoilt(table(spark, d, "bus_events")))))


@query(f"WITH {SPOILT_SQL} SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(data, '$.document_id')) AS documents FROM dec WHERE error IS NULL GROUP BY event_type")
def stream_decode(spark, d):
    out = _folder(spark, "decoded")
    bus.run_stage(_spoilt(bus.stream_of(spark, f"{d}/bus_events.parquet")), lambda good: good.select("event_type", F.col("payload.document_id").alias("document_id")), out, f"{out}-letters", f"{out}-checkpoint")
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


@query(f"WITH {SPOILT_SQL} SELECT stream AS origin_stream, error, count(*) AS n FROM dec WHERE error IS NOT NULL GROUP BY ALL")
def stream_dead_letters(spark, d):
    out = _folder(spark, "letters")
    bus.run_stage(_spoilt(bus.stream_of(spark, f"{d}/bus_events.parquet")), lambda good: good.select("event_id"), out, f"{out}-letters", f"{out}-checkpoint")
    return spark.read.parquet(f"{out}-letters").groupBy("origin_stream", "error").agg(F.count("*").alias("n"))


@query(f"SELECT key AS event_id, 1::BIGINT AS n FROM (SELECT {P4_KEY} AS key FROM bus_events) WHERE key IS NOT NULL GROUP BY key")
def stream_first_deliveries(spark, d):
    out = _folder(spark, "first")
    q = bus.first_deliveries(bus.stream_of(spark, f"{d}/bus_events.parquet", 1_000_000), "3650 days").writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out).select(message_key(F.col("event_id")).alias("event_id")).filter("event_id IS NOT NULL").groupBy("event_id").agg(F.count("*").alias("n"))


@query(SQL["parse_status"])
def stream_parse(spark, d):
    out = _folder(spark, "parsed")
    docs = bus.stream_of(spark, f"{d}/source_documents.parquet")
    q = ops.parse(docs).select("id", "status", "failed_stage", "language").writeStream.format("parquet").option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.parquet(out)


@query(f"WITH {DUP} SELECT document_id, duplicate_of FROM dup")
def stream_dedup(spark, d):
    out = _folder(spark, "dedup")
    bus.dedup_stage(bus.stream_of(spark, f"{d}/documents.parquet", 1_000_000), f"{out}-store", out, f"{out}-checkpoint")
    return spark.read.parquet(out).select("document_id", "duplicate_of")


@query("SELECT id AS document_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-' || substr(d, 13, 4) || '-' || substr(d, 17, 4) || '-' || substr(d, 21, 12) AS event_id, hash AS content_hash FROM (SELECT id, md5('doc.parsed:' || id) AS d, sha256(body) AS hash FROM source_documents WHERE body IS NOT NULL)")
def publish_events(spark, d):
    rows = table(spark, d, "source_documents").filter("body IS NOT NULL").withColumn("document_id", F.col("id"))
    sent = bus.publish(rows, "doc.parsed", F.col("id"), F.col("created_at"), ["source_id", "document_id"], text.content_hash(F.col("body")))
    read = bus.decode(sent.withColumn("stream", F.lit("doc.parsed"))).filter("error IS NULL")
    return read.select("payload.document_id", "payload.event_id", "payload.content_hash")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark, d):
    out = _folder(spark, "windows")
    counts = bus.windowed(bus.stream_of(spark, f"{d}/events.parquet", 1_000_000), "ts", ["event_type"])

    def last(df, number):
        df.write.mode("overwrite").parquet(out)

    q = counts.writeStream.outputMode("complete").foreachBatch(last).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
