"""Near-duplicate detection as the pipeline does it: shingles, MinHash signatures, bands, and the earliest match per document.

A document is a duplicate if an earlier one shares a band with it and agrees in at least 85 % of the
signature. Signatures of duplicates are kept, so every document is compared with all earlier ones: one
self-join on bands, no iteration.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tailrace.operators.relational import band_candidates
from tailrace.session import materialize

NUM_PERM = 128
BAND_SIZE = 4
THRESHOLD = 0.85
SHINGLE = 5
PRIME = (1 << 31) - 1


def permutations(n: int = NUM_PERM) -> list[tuple[int, int]]:
    """(a, b) of n universal hash functions, by a linear congruential rule."""
    out, x = [], 12345
    for _ in range(n):
        x = (1103515245 * x + 12345) % (1 << 31)
        a = 1 + x % (PRIME - 1)
        x = (1103515245 * x + 12345) % (1 << 31)
        out.append((a, x % PRIME))
    return out


def shingles(x: Column, k: int = SHINGLE) -> Column:
    """The distinct runs of k words, lower-cased, split at white space; a shorter text is one run, an empty one the empty run."""
    words = F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")

    def runs(w: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(each))

    # the words are bound to a lambda's variable: named inside the inner lambda, the split would run once per word
    return F.get(F.transform(F.array(words), runs), F.lit(0))


def shingle_codes(x: Column) -> Column:
    """Each shingle as a number below the prime: the first eight hex digits of its MD5."""
    return F.transform(shingles(x), lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long") % PRIME)


def minhash(batches):
    """Signatures of Arrow batches ``document_id, codes``: for each permutation the least (a * code + b) mod prime. Codes and factors fit in 31 bits, products in 62."""
    ab = np.array(permutations(), dtype=np.uint64)
    a, b = ab[:, :1], ab[:, 1:]
    for batch in batches:
        values = [((a * np.asarray(c, dtype=np.uint64) + b) % np.uint64(PRIME)).min(axis=1).astype(np.int64) if c else None for c in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.list_(pa.int64()))], ["document_id", "hashvalues"])


def bands(hashvalues: Column, size: int = BAND_SIZE, num_perm: int = NUM_PERM) -> Column:
    """``b<i>:<md5 of the band's values in list form>``."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_perm // size - 1)), lambda i: F.concat(F.lit("b"), i.cast("string"), F.lit(":"), F.md5(F.concat(F.lit("["), F.array_join(F.slice(hashvalues, i * size + 1, size).cast("array<string>"), ", "), F.lit("]")))))


def signature_similarity(x: Column, y: Column) -> Column:
    """Share of equal positions; 0 for different lengths."""
    equal = F.size(F.filter(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: z["x"] == z["y"]))
    return F.when((F.size(x) == F.size(y)) & (F.size(x) > 0), equal / F.size(x)).otherwise(F.lit(0.0))


def signatures(docs: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``document_id, hashvalues, band_hashes`` of every document with a body."""
    codes = docs.filter(F.col(body).isNotNull()).select(F.col(key).alias("document_id"), shingle_codes(F.col(body)).alias("codes"))
    kind = docs.schema[key].dataType.simpleString()
    return codes.mapInArrow(minhash, f"document_id {kind}, hashvalues array<bigint>").withColumn("band_hashes", bands(F.col("hashvalues")))


def near_duplicates(sigs: DataFrame, arrival: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``document_id, duplicate_of, similarity``: the earliest document that a later one repeats. ``arrival``: ``document_id, seq``."""
    sigs = materialize(sigs, "signatures")
    known = sigs.select("document_id", "hashvalues").join(arrival, "document_id")
    x = known.select(F.col("document_id").alias("a"), F.col("hashvalues").alias("ha"), F.col("seq").alias("sa"))
    y = known.select(F.col("document_id").alias("b"), F.col("hashvalues").alias("hb"), F.col("seq").alias("sb"))
    pairs = band_candidates(sigs).join(x, "a").join(y, "b").withColumn("j", signature_similarity(F.col("ha"), F.col("hb"))).filter(F.col("j") >= threshold)
    ordered = pairs.select(F.when(F.col("sa") < F.col("sb"), F.struct(F.col("b").alias("late"), F.col("a").alias("early"), F.col("sa").alias("s"), "j")).otherwise(F.struct(F.col("a").alias("late"), F.col("b").alias("early"), F.col("sb").alias("s"), "j")).alias("p")).select("p.*")
    best = ordered.groupBy("late").agg(F.min(F.struct("s", "early", "j")).alias("m"))
    return best.select(F.col("late").alias("document_id"), F.col("m.early").alias("duplicate_of"), F.col("m.j").alias("similarity"))


def dedup_status(docs: DataFrame, duplicates: DataFrame, key: str = "id", body: str = "body") -> DataFrame:
    """``document_id, status, duplicate_of``: failed without a body, duplicate or deduped."""
    d = duplicates.select(F.col("document_id").alias("_d"), "duplicate_of")
    j = docs.select(F.col(key).alias("document_id"), F.col(body).isNull().alias("missing")).join(d, F.col("document_id") == F.col("_d"), "left")
    return j.select("document_id", F.when(F.col("missing"), "failed").when(F.col("duplicate_of").isNotNull(), "duplicate").otherwise("deduped").alias("status"), "duplicate_of")


def duplicate_rate(status: DataFrame) -> DataFrame:
    dup, kept = F.count_if(F.col("status") == "duplicate"), F.count_if(F.col("status") == "deduped")
    return status.agg(dup.alias("duplicates"), kept.alias("kept"), F.coalesce(F.round(F.try_divide(100.0 * dup, dup + kept), 1), F.lit(0.0)).alias("rate"))
