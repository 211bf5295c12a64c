"""Mixing sources to target weights.

Tokens are counted once per text by a public tokenizer, summed per source, and turned into a rate per source:
how often each of its documents must appear so that the source fills its share, at most ``max_repeats`` times.
Each document is then emitted floor(rate) times, plus once more if a hash of its id and the seed falls below
the rest of the rate. No shuffle carries a text.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.session import materialize, small

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict = {}


def encoder(path: str):
    """The tokenizer whose ranks ``path`` holds, once per process; on executors the file that was sent with the job stands in for a path that isn't there."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _count(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            ids, sources, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "source", "text"))
            n = [len(enc.encode_to_numpy(t)) if t else 0 for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, sources, pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return run


def token_counts(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens`` of every row; a null text has no tokens."""
    if os.path.exists(path):
        docs.sparkSession.sparkContext.addFile(path)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(_count(path), "doc_id bigint, source string, tokens bigint")


def clean_targets(targets: DataFrame) -> DataFrame:
    """One row per source: ``source, share`` (scaled to sum to 1)``, max_repeats``. Rows without a source or a positive share ask for nothing."""
    rows = targets.filter("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("share").alias("_all")))).select("source", (F.col("share") / F.col("_all")).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))


def mix_rates(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, tokens, target_share, max_repeats, wanted, rate, short``: how often each document of a source appears.

    The mix is as large as the text of all listed sources taken once. ``short``: even ``max_repeats`` times the
    source's text stays below its share. A listed source without text has rate 0 and is short.
    """
    per = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    listed = clean_targets(targets).join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0).cast("long")))
    total = listed.agg(F.sum("tokens").alias("_total"))
    wanted = F.col("share") * F.col("_total")
    return listed.crossJoin(F.broadcast(total)).select(
        "source", "tokens", F.col("share").alias("target_share"), "max_repeats", wanted.alias("wanted"),
        F.when(F.col("tokens") > 0, F.least(wanted / F.greatest(F.col("tokens"), F.lit(1)), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0)).alias("rate"),
        (F.col("tokens") * F.col("max_repeats") < wanted).alias("short"),
    )


def copies(rate, key, seed: int):
    """floor(rate), plus one with probability of the rest, by hash of ``key``."""
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11).cast("double") / float(1 << 53)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("int")


class Mix:
    """``docs``: ``doc_id, source, text``; ``targets``: ``source, target_share, max_repeats``. Rows of unlisted or null sources take no part; equal rows
    of one id get as many copies each; null texts have no tokens; empty tables give an empty mix."""

    def __init__(self, docs: DataFrame, targets: DataFrame, seed: int = 0, path: str = VOCABULARY):
        self.docs, self.seed = docs, seed
        listed = targets.select("source").filter("source IS NOT NULL").distinct()
        self.counts = materialize(token_counts(docs.select("doc_id", "source", "text").join(small(listed), "source", "left_semi"), path), "tokens")
        #: see ``mix_rates``.
        self.rates = materialize(mix_rates(self.counts, targets), "rates")

    def copies(self) -> DataFrame:
        """``doc_id, source, tokens, copies`` of every document that appears."""
        r = self.rates.select("source", "rate")
        return self.counts.join(small(r), "source").select("doc_id", "source", "tokens", copies(F.col("rate"), F.col("doc_id"), self.seed).alias("copies")).filter("copies > 0")

    def documents(self) -> DataFrame:
        """The mix itself: all columns of ``docs`` and ``copy_no`` from 1."""
        r = self.rates.select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
        n = copies(F.col("_rate"), F.col("doc_id").cast("long"), self.seed)
        return self.docs.join(small(r), F.col("source") == F.col("_source")).withColumn("_n", n).filter("_n > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_source", "_rate", "_n")

    def shares(self) -> DataFrame:
        """``source, target_share, actual_share, rate, short``."""
        got = self.copies().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"))
        total = got.agg(F.sum("mixed").alias("_all"))
        return self.rates.join(got, "source", "left").crossJoin(F.broadcast(total)).select("source", "target_share", (F.coalesce("mixed", F.lit(0)) / F.col("_all")).alias("actual_share"), "rate", "short")
