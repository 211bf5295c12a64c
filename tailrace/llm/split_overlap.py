"""The same or nearly the same record in more than one split, by content-defined chunks.

A record is normalised to its words. A hash rolls over the last ``WINDOW`` bytes and the text is cut where it
meets a pattern, so that cuts move with the text: an edit changes only the chunks it touches. Chunk digests
are joined across splits and the lengths of shared chunks are summed into the overlap of each pair of
records, as a fraction of the longer one. The overlap only gates: what reaches it is compared run by run of
words, and that likeness decides.

Short records have too few chunks for that: one edit may touch them all. So records of at most ``SHORT`` runs are
chunked at the finest grain, each run of five words a chunk of length one, and must overlap as far as they must be
alike, which no pair can miss. Records a little longer are chunked at both grains, so that any two records that
can be alike meet at one of them.

Only a record's rarest chunks are joined: those that make up all but the gate's share of its length. Two records
that share at least that share a chunk among them (prefix filtering), so frequent phrases cost nothing and no
pair is lost. Equal records are one class throughout. No text is shuffled but those of candidates.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tailrace.llm.words import K, shingle_hashes, text_digest, words
from tailrace.session import materialize, small

WINDOW = 12
#: Mean chunk length in bytes is 2 ** CUT_BITS plus what the window adds.
CUT_BITS = 5
#: Least share of the longer record, in bytes, that lies in shared chunks of a candidate.
OVERLAP = 0.2
#: Runs of words up to which a pair of records is compared by its runs; of 3,000 random pairs of 128 words and likeness just over 0.7 the least overlap by chunks was 0.24.
SHORT = 128
COARSE, FINE = 0, 1

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``: where the top bits of the rolling hash of the last ``WINDOW`` bytes are zero, and at its end."""
    b = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    if len(b) <= WINDOW:
        return [len(b)]
    n = len(b) - WINDOW + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        h = h * _BASE + b[j : j + n]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    at = (np.nonzero((h >> np.uint64(64 - CUT_BITS)) == 0)[0] + WINDOW).tolist()
    if not at or at[-1] != len(b):
        at.append(len(b))
    return at


def chunks(data: bytes) -> list[tuple[int, int]]:
    """(digest, length) of each distinct chunk; a chunk that comes back counts once with its whole length."""
    out: dict[int, int] = {}
    start = 0
    for end in cuts(data):
        h = xxhash.xxh3_64_intdigest(data[start:end])
        h = h - (1 << 64) if h >> 63 else h
        out[h] = out.get(h, 0) + end - start
        start = end
    return list(out.items())


def grains(ws: list[str], least: float) -> list[tuple[int, list[int], list[int], int]]:
    """(grain, chunk digests, their lengths, the record's length) of a record's words, for each grain it is chunked at."""
    runs = np.unique(shingle_hashes(ws)).view(np.int64)
    out = []
    if len(runs) > SHORT:
        data = " ".join(ws).encode("utf-8", "surrogatepass")
        found = chunks(data)
        out.append((COARSE, [h for h, _ in found], [n for _, n in found], len(data)))
    if len(runs) * least <= SHORT:
        out.append((FINE, runs.tolist(), [1] * len(runs), len(runs)))
    return out


def overlap_of(a: list[str], b: list[str], least: float) -> float:
    """Lengths of the chunks two records share, as a fraction of the longer one, at the finest grain both have; 0 if they have none in common."""
    return _shared(_by_grain(a, least), _by_grain(b, least))


def _by_grain(ws: list[str], least: float) -> dict[int, tuple[np.ndarray, np.ndarray, int]]:
    out = {}
    for g, h, n, size in grains(ws, least):
        order = np.argsort(np.array(h, dtype=np.int64))
        out[g] = (np.array(h, dtype=np.int64)[order], np.array(n, dtype=np.int64)[order], size)
    return out


def _shared(x: dict, y: dict) -> float:
    for g in (FINE, COARSE):
        if g in x and g in y:
            _, i, j = np.intersect1d(x[g][0], y[g][0], assume_unique=True, return_indices=True)
            return int(np.minimum(x[g][1][i], y[g][1][j]).sum()) / max(x[g][2], y[g][2])
    return 0.0


@lru_cache(maxsize=1024)
def _prepared(text: str, least: float) -> tuple[dict, np.ndarray]:
    """A candidate's chunks and its distinct runs: it may stand in several pairs of a batch."""
    ws = text.split(" ")
    return _by_grain(ws, least), np.unique(shingle_hashes(ws))


def _cut(least: float):
    """Each record's digest and chunks; records of fewer than five words have none and are left out."""

    def run(batches):
        for batch in batches:
            ids, sides, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "trained", "text"))
            rows = []
            for i, s, t in zip(ids, sides, texts):
                ws = words(t)
                if len(ws) >= K:
                    rows.append((i, s, text_digest(ws), [{"grain": g, "size": size, "chunks": h, "lengths": n} for g, h, n, size in grains(ws, least)]))
            grain = pa.struct([("grain", pa.int32()), ("size", pa.int32()), ("chunks", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.int64(), pa.bool_(), pa.string(), pa.list_(grain)))], ["id", "trained", "digest", "grains"])

    return run


_CUT = "id bigint, trained boolean, digest string, grains array<struct<grain:int,size:int,chunks:array<bigint>,lengths:array<int>>>"


def _normalise(batches):
    for batch in batches:
        rows = [(text_digest(ws), " ".join(ws)) for ws in (words(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()) if len(ws) >= K]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], ["digest", "text"])


def _compare(least: float, overlap: float):
    def run(batches):
        for batch in batches:
            a, b, texts_a, texts_b = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            rows = []
            for d, e, p, q in zip(a, b, texts_a, texts_b):
                (x, runs), (y, others) = _prepared(p, least), _prepared(q, least)
                shared = _shared(x, y)
                if shared >= overlap:
                    both = len(np.intersect1d(runs, others, assume_unique=True))
                    alike = both / (len(runs) + len(others) - both)
                    if alike >= least:
                        rows.append((d, e, shared, alike))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.string(), pa.string(), pa.float64(), pa.float64()))], ["a", "b", "overlap", "likeness"])

    return run


class SplitOverlap:
    """Overlaps between the ``train`` records and the records of all other splits.

    ``records``: ``example_id, text, split``, optionally ``source``; further columns are ignored.
    Null and blank texts, texts of fewer than five words and rows without an id or a split never overlap;
    repeated rows of an id count once; an empty table gives no overlaps.
    """

    def __init__(self, records: DataFrame, least: float = 0.8, overlap: float = OVERLAP, train: str = "train"):
        slim = records.select(F.col("example_id").cast("long").alias("id"), (F.lower(F.trim("split")) == train).alias("trained"), "text").filter("id IS NOT NULL AND trained IS NOT NULL AND text IS NOT NULL")
        cut = materialize(slim.mapInArrow(_cut(least), _CUT), "chunks")
        #: ``id, digest, trained``: the class of each record and its side.
        self.members = cut.select("id", "digest", "trained").distinct()
        # chunks travel with 60 bits of the digest; classes that share them are all compared
        short = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
        classes = cut.groupBy("digest").agg(F.max(F.col("trained").cast("int")).alias("in_train"), F.max((~F.col("trained")).cast("int")).alias("in_rest"), F.any_value("grains").alias("grains"))
        classes = materialize(classes.select(short.alias("k"), "in_train", "in_rest", "grains"), "classes")
        each = classes.select("k", "in_train", "in_rest", F.inline("grains"))
        each = each.select("k", "in_train", "in_rest", "grain", "size", F.inline(F.arrays_zip(F.col("chunks").alias("chunk"), F.col("lengths").alias("n"))))
        # a chunk matters only if it stands on both sides
        both = each.groupBy("grain", "chunk").agg(F.count("*").alias("df"), F.max("in_train").alias("t"), F.max("in_rest").alias("r")).filter("df > 1 AND t = 1 AND r = 1").select("grain", "chunk", "df")
        ranked = each.join(both, ["grain", "chunk"])
        order = Window.partitionBy("k", "grain").orderBy("df", "chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # chunks on one side only come first in the order: their length is what is missing from the sum
        before = F.col("size") - F.sum("n").over(Window.partitionBy("k", "grain")) + F.sum("n").over(order) - F.col("n")
        gate = F.when(F.col("grain") == FINE, F.lit(max(least, overlap))).otherwise(F.lit(overlap))
        rare = ranked.withColumn("before", before).filter(F.col("before") <= (1 - gate) * F.col("size") + 1e-6)
        rare = materialize(rare.select("grain", "chunk", "k", "in_train", "in_rest"), "rare-chunks")
        x = rare.filter("in_train = 1").select("grain", "chunk", F.col("k").alias("a"))
        y = rare.filter("in_rest = 1").select("grain", "chunk", F.col("k").alias("b"))
        candidates = materialize(x.join(y, ["grain", "chunk"]).filter("a <> b").select("a", "b").distinct(), "candidates")
        # the texts of candidates, one row of each class
        wanted = candidates.select(F.col("a").alias("k")).unionByName(candidates.select(F.col("b").alias("k"))).distinct()
        one = materialize(self.members.select("digest", "id", short.alias("k")).join(wanted, "k", "left_semi").groupBy("digest").agg(F.min("id").alias("id")), "candidate-rows")
        texts = slim.join(small(one.select("id").distinct()), "id", "left_semi").select("text").mapInArrow(_normalise, "digest string, text string")
        texts = materialize(texts.dropDuplicates(["digest"]).withColumn("k", short), "candidate-texts")
        with_text = candidates.join(texts.select(F.col("k").alias("a"), F.col("digest").alias("da"), F.col("text").alias("text_a")), "a")
        with_text = with_text.join(texts.select(F.col("k").alias("b"), F.col("digest").alias("db"), F.col("text").alias("text_b")), "b").select(F.col("da").alias("a"), F.col("db").alias("b"), "text_a", "text_b")
        #: ``a`` (a text in train), ``b`` (a text outside), their overlap by chunks and their likeness.
        self.links = materialize(with_text.mapInArrow(_compare(least, overlap), "a string, b string, overlap double, likeness double"), "overlaps")

    def _sides(self) -> tuple[DataFrame, DataFrame]:
        return (
            self.members.filter("trained").select(F.col("digest").alias("a"), F.col("id").alias("x")),
            self.members.filter("NOT trained").select(F.col("digest").alias("b"), F.col("id").alias("y")),
        )

    def pairs(self) -> DataFrame:
        """``(example_id_a, example_id_b)``, smaller id first: one in train, the other outside, copies included."""
        x, y = self._sides()
        near = self.links.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
        same = x.join(y, F.col("a") == F.col("b")).select("x", "y")
        return near.unionByName(same).select(F.least("x", "y").alias("example_id_a"), F.greatest("x", "y").alias("example_id_b")).filter("example_id_a <> example_id_b").distinct()

    def records(self) -> DataFrame:
        """One row per overlapping record outside train: ``example_id``, its class, train texts it is close to and its largest overlap."""
        x, y = self._sides()
        copies = self.members.filter("trained").select(F.col("digest").alias("b")).distinct().withColumn("a", F.col("b")).withColumn("overlap", F.lit(1.0))
        hits = self.links.select("a", "b", "overlap").unionByName(copies.select("a", "b", "overlap"))
        per = hits.groupBy("b").agg(F.count("*").alias("train_texts"), F.max("overlap").alias("overlap"))
        return y.join(per, "b").select(F.col("y").alias("example_id"), F.col("b").alias("class_id"), "train_texts", "overlap")


def overlap_report(records: DataFrame, least: float = 0.8, overlap: float = OVERLAP) -> DataFrame:
    """``split, source, n_records, n_overlapping`` of every split but train."""
    found = SplitOverlap(records, least, overlap).records().select(F.col("example_id").alias("_hit")).distinct()
    rest = records.select(F.col("example_id").cast("long").alias("example_id"), F.lower(F.trim("split")).alias("split"), "source").filter("split IS NOT NULL AND split <> 'train'").distinct()
    return rest.join(found, F.col("example_id") == F.col("_hit"), "left").groupBy("split", "source").agg(F.count("*").alias("n_records"), F.count("_hit").alias("n_overlapping"))
