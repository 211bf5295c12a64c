"""The event bus as Structured Streaming: typed messages, dead letters, retries, idempotent stages.

A stream of the bus is a folder of parquet files with the columns ``event_type, version, data`` and where the
message stands. Consumer groups and acknowledgements are Spark's checkpoints: a batch is done when its
output and its commit are written, and is run again if not, so stages drop what they have written before.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tailrace.operators.messages import message_key
from tailrace.session import materialize

ENVELOPE = {"event_id": "string", "occurred_at": "string", "content_hash": "string", "event_type": "string", "version": "int"}

# fixed values: the messages' own fields; True for those that must be there
EVENTS: dict[str, dict[str, tuple[str, bool]]] = {
    "ingest.requested": {"source_id": ("string", True), "uri": ("string", False)},
    "doc.discovered": {"source_id": ("string", True), "document_id": ("string", True), "url": ("string", True)},
    "doc.fetched": {"source_id": ("string", True), "document_id": ("string", True), "content_hash": ("string", True)},
    "doc.parsed": {"source_id": ("string", True), "document_id": ("string", True), "content_hash": ("string", True)},
    "doc.deduped": {"document_id": ("string", True), "content_hash": ("string", True), "is_duplicate": ("boolean", False), "duplicate_of": ("string", False)},
    "doc.classified": {"document_id": ("string", True), "incident_id": ("string", True), "content_hash": ("string", True), "labels": ("array<string>", False)},
}

_FIELDS = dict(ENVELOPE)
for _own in EVENTS.values():
    _FIELDS |= {k: t for k, (t, _) in _own.items()}
PAYLOAD = ", ".join(f"{k} {t}" for k, t in _FIELDS.items())

MAX_RETRIES = 3
BASE_SECONDS = 1.0


def payload_error(event_type: Column, version: Column, data: Column) -> Column:
    """Why a message can't be read, null if it can: no JSON object, unknown type or version, a required field missing, a field that isn't its own."""
    keys = F.json_object_keys(data)
    out = F.when(F.try_parse_json(data).isNull() | keys.isNull(), "parse_error").when(~event_type.isin(*EVENTS) | event_type.isNull(), "unknown_type").when(F.coalesce(version, F.lit(-1)) != 1, "unknown_version")
    for name, own in EVENTS.items():
        required = [k for k, (_, must) in own.items() if must]
        allowed = F.array(*[F.lit(k) for k in {**ENVELOPE, **own}])
        missing = F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys)) > 0
        for k in required:
            missing = missing | F.get_json_object(data, f"$.{k}").isNull()
        out = out.when((event_type == name) & missing, "missing_field").when((event_type == name) & (F.size(F.array_except(keys, allowed)) > 0), "extra_field")
    return out


def decode(messages: DataFrame) -> DataFrame:
    """``messages`` with ``error`` and, where that is null, the ``payload``."""
    error = payload_error(F.col("event_type"), F.col("version"), F.col("data"))
    return messages.withColumn("error", error).withColumn("payload", F.when(F.col("error").isNull(), F.from_json("data", PAYLOAD)))


def dead_letters(decoded: DataFrame, attempts: int = 0) -> DataFrame:
    """What goes to the dead letters: the message's own columns, ``error, attempts, origin_stream, origin_entry_id``."""
    entry = F.concat_ws("-", F.coalesce(F.col("batch_no").cast("string"), F.lit("")), F.coalesce("event_id", F.lit("")))
    return decoded.filter("error IS NOT NULL").select("event_id", "event_type", "version", "data", "error", F.lit(attempts).alias("attempts"), F.col("stream").alias("origin_stream"), entry.alias("origin_entry_id"))


def publish(rows: DataFrame, event_type: str, key: Column, occurred_at: Column, fields: list[str], content_hash: Column | None = None) -> DataFrame:
    """Messages of one type: the payload as JSON with its type and version; identifiers derive from ``key``, so that publishing again gives the same."""
    digest = F.md5(F.concat(F.lit(event_type + ":"), key))
    event_id = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    hash_ = content_hash if content_hash is not None else F.lit(None).cast("string")
    body = F.struct(event_id.alias("event_id"), F.date_format(occurred_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("occurred_at"), hash_.alias("content_hash"), F.lit(event_type).alias("event_type"), F.lit(1).alias("version"), *[F.col(f) for f in fields if f not in ENVELOPE])
    return rows.select(event_id.alias("event_id"), F.lit(event_type).alias("event_type"), F.lit(1).alias("version"), F.to_json(body).alias("data"))


def backoff(attempt: int, jitter: Callable[[], float] = random.random) -> float:
    """Seconds to wait after the ``attempt``-th failure: 1, 2, 4, ... plus up to one."""
    return BASE_SECONDS * 2 ** (attempt - 1) + jitter()


def stream_of(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream over a parquet folder, or over a single file by its name."""
    schema = spark.read.parquet(path).schema
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_stage(messages: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, letters: str, checkpoint: str, max_retries: int = MAX_RETRIES, sleep: Callable[[float], None] = time.sleep, jitter: Callable[[], float] = random.random) -> StreamingQuery:
    """Work off all messages that are there: unreadable ones become dead letters at once, the rest go to ``handle``.

    A batch that fails is tried again ``max_retries`` times, each after a growing pause. If it still fails it is halved by
    a hash of its messages, and each half that fails again, until the messages that fail by themselves are left: only they become
    dead letters, with the number of retries. Each batch writes to a folder of its own, overwritten when it is
    run again after a lost executor or driver, so nothing is doubled.
    """

    def once(part: DataFrame) -> tuple[DataFrame | None, str]:
        try:
            return materialize(handle(part), "handled"), ""
        except Exception as e:  # noqa: BLE001 - any failure of the handler counts as an attempt
            return None, type(e).__name__

    def halves(part: DataFrame, depth: int) -> tuple[list[DataFrame], list[DataFrame]]:
        """(what the handler makes of the good messages, the dead letters) of a part that failed."""
        done: list[DataFrame] = []
        dead: list[DataFrame] = []
        bit = F.shiftrightunsigned(F.col("_hash"), depth).bitwiseAND(1)
        for half in (part.filter(bit == 0), part.filter(bit == 1)):
            found = half.limit(2).count()
            if not found:
                continue
            result, error = once(half.drop("_hash"))
            if result is not None:
                done.append(result)
            elif found == 1 or depth == 63:
                dead.append(dead_letters(half.drop("_hash").withColumn("error", F.lit(error)), max_retries))
            else:
                d, x = halves(half, depth + 1)
                done += d
                dead += x
        return done, dead

    def batch(df: DataFrame, number: int) -> None:
        decoded = decode(df)
        good = decoded.filter("error IS NULL")
        bad = dead_letters(decoded)
        result, _ = once(good)
        for attempt in range(1, max_retries + 1):
            if result is not None:
                break
            sleep(backoff(attempt, jitter))
            result, _ = once(good)
        if result is not None:
            done, dead = [result], []
        else:
            done, dead = halves(materialize(good.withColumn("_hash", F.xxhash64("stream", "batch_no", "event_id", "data")), "failed"), 0)
        for part in dead:
            bad = bad.unionByName(part)
        if done:
            whole = done[0]
            for part in done[1:]:
                whole = whole.unionByName(part)
            whole.write.mode("overwrite").parquet(f"{out}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{letters}/batch={number}")

    query = messages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def first_deliveries(messages: DataFrame, delay: str = "7 days") -> DataFrame:
    """A stream with each identifier once, as long as its deliveries come within ``delay`` of each other. Rows without an identifier are messages of their own; equal ones are one."""
    keyed = messages.withColumn("_key", F.coalesce(message_key(F.col("event_id")), F.concat(F.lit("~"), F.sha2(F.to_json(F.struct(*messages.columns)), 256))))
    return keyed.withWatermark("delivered_at", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def letter_depth(letters: DataFrame) -> DataFrame:
    """``origin_stream, n`` over all streams."""
    return letters.groupBy("origin_stream").agg(F.count("*").alias("n"))


def dedup_stage(docs: DataFrame, store: str, out: str, checkpoint: str, key: str = "doc_id", body: str = "text") -> StreamingQuery:
    """Near-duplicate detection over a stream of documents: each batch is compared with the signatures stored so far and with itself.

    ``out`` gets ``document_id, duplicate_of, similarity`` by batch. Signatures are stored by batch, so a batch
    that is run again replaces its own.
    """
    from tailrace.operators import dedup

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        fresh = materialize(dedup.signatures(df.dropDuplicates([key]), key, body).withColumn("seq", F.struct(F.lit(number).cast("long").alias("batch"), F.col("document_id").alias("id"))), "batch-signatures")
        known = fresh
        if number:
            old = spark.read.schema(fresh.schema).parquet(*[f"{store}/batch={i}" for i in range(number)])
            # of the store only signatures that share a band with the batch are read on
            touched = old.select("document_id", F.explode("band_hashes").alias("band")).join(fresh.select(F.explode("band_hashes").alias("band")).distinct(), "band", "left_semi").select("document_id").distinct()
            known = fresh.unionByName(old.join(touched, "document_id", "left_semi"))
        found = dedup.near_duplicates(known.drop("seq"), known.select("document_id", "seq"))
        found.join(fresh.select("document_id"), "document_id", "left_semi").write.mode("overwrite").parquet(f"{out}/batch={number}")
        fresh.write.mode("overwrite").parquet(f"{store}/batch={number}")

    query = docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed(events: DataFrame, ts: str, keys: list[str], size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts per event-time window; an extra, the pipeline itself has no windows. ``TIMESTAMP_NTZ`` is cast, as watermarks need."""
    t = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    w = F.window("_ts", size, slide) if slide else F.window("_ts", size)
    return t.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")
