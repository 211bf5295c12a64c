"""Exactly one copy of messages that were delivered at least once.

Only identifiers, delivery order and the place of each row (file and position in it) are shuffled. From them
the winner of each message is chosen; all other places become deletion vectors, one bitmap per file and
block of 65,536 rows. The second scan reads the wide payload and drops deleted places as it goes: with the
vectors broadcast while they are small, else each task fetches the vectors of its own files from the shared folder.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.session import BROADCAST_BYTES, materialize, open_folder, small, table_bytes, work_dir

BLOCK_BITS = 16


def message_key(event_id: Column) -> Column:
    """One spelling for all of an identifier: a UUID as lower-case hyphenated text, whatever its case, braces, prefix,
    hyphens and blanks; anything else trimmed and lower-cased; null for null and blank."""
    plain = F.regexp_replace(F.lower(event_id.cast("string")), "[\\s\\u00a0]+", "")
    digits = F.regexp_replace(F.regexp_replace(plain, "^(urn:)?(uuid:)?", ""), "[{}()-]", "")
    uuid = F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(digits.rlike("^[0-9a-f]{32}$"), uuid).otherwise(F.nullif(plain, F.lit("")))


def places(messages: DataFrame, order: list[str]) -> DataFrame:
    """``key, ord, file, row`` of every row with an identifier; nothing else of the row is read."""
    here = messages.select(message_key(F.col("event_id")).alias("key"), F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("~")).alias(c) if dict(messages.dtypes)[c] == "string" else F.col(c) for c in order]).alias("o"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    missing = F.lit(False)
    for c in order:  # a missing delivery time or number comes last
        missing = missing | F.col(f"o.{c}").isNull()
    return here.filter("key IS NOT NULL").select("key", F.struct(missing.alias("late"), F.col("o"), F.col("file"), F.col("row")).alias("ord"))


def deliveries(messages: DataFrame, order: tuple[str, ...] = ("delivered_at", "batch_no")) -> DataFrame:
    """``key, n_deliveries, ord`` of each message: how often it came and the place of the first delivery.

    The grouping combines in each task before it shuffles, so that a message that holds a third of all rows
    is one row per task.
    """
    return places(messages, list(order)).groupBy("key").agg(F.count("*").alias("n_deliveries"), F.min("ord").alias("ord"))


def deletion_vectors(messages: DataFrame, order: tuple[str, ...] = ("delivered_at", "batch_no")) -> DataFrame:
    """``file, block, words``: per file and block of rows a bitmap (1,024 longs) of the rows that aren't first deliveries.

    Winners of messages that came once delete nothing and are left out, so that the second look at the places joins the
    repeated messages alone: broadcast while they are small, else in a join that adaptive execution splits where a message is hot.
    """
    first = materialize(deliveries(messages, order).filter("n_deliveries > 1").select("key", F.col("ord.file").alias("f"), F.col("ord.row").alias("r")), "winners")
    rest = places(messages, list(order)).select("key", F.col("ord.file").alias("file"), F.col("ord.row").alias("row")).join(small(first), "key").filter("file <> f OR row <> r")
    word = rest.groupBy("file", F.shiftright("row", BLOCK_BITS).alias("block"), F.shiftright(F.col("row").bitwiseAND((1 << BLOCK_BITS) - 1), 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(row & 63 AS int)))").alias("bits"))
    # at most 1,024 words a block: the group is bounded
    return word.groupBy("file", "block").agg(F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("m")).select(
        "file", "block", F.transform(F.sequence(F.lit(0), F.lit((1 << BLOCK_BITS) // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words")
    )


def _vectors(messages: DataFrame, order: tuple[str, ...], limit: int) -> tuple[DataFrame, bool]:
    """The deletion vectors, written, and whether they may be broadcast."""
    vectors = materialize(deletion_vectors(messages, order), "deletion-vectors")
    return vectors, table_bytes(vectors.select("file", "block")) + vectors.count() * ((1 << BLOCK_BITS) // 8) <= limit


def exactly_once(messages: DataFrame, order: tuple[str, ...] = ("delivered_at", "batch_no"), limit: int = BROADCAST_BYTES) -> DataFrame:
    """``messages`` with the first delivery of each identifier only.

    ``messages`` is a plain parquet scan (its rows' places are read from the files' metadata). Rows without an
    identifier are messages of their own and all stay; ties in ``order`` go to the earlier file and row; equal
    payloads under different identifiers stay; rows with a missing delivery time come last; an empty table
    stays empty; further columns, whatever their names, are passed on.
    """
    vectors, fit = _vectors(messages, order, limit)
    return (_by_join if fit else _by_fetch)(messages, vectors, messages.columns, False)


def _by_join(messages: DataFrame, vectors: DataFrame, columns: list[str], deleted: bool) -> DataFrame:
    """``columns`` of the rows of ``messages`` that the vectors delete, or all others."""
    row = F.col("_metadata.row_index")
    here = messages.select(*columns, F.col("_metadata.file_path").alias("__file"), F.shiftright(row, BLOCK_BITS).alias("__block"), row.bitwiseAND((1 << BLOCK_BITS) - 1).cast("int").alias("__row"))
    gone = F.broadcast(vectors.select(F.col("file").alias("__file"), F.col("block").alias("__block"), F.col("words").alias("__words")))
    bit = F.getbit(F.get("__words", F.shiftright("__row", 6)), F.col("__row").bitwiseAND(63))
    wanted = bit == 1 if deleted else F.col("__words").isNull() | (bit == 0)
    return here.join(gone, ["__file", "__block"], "left").filter(wanted).select(*columns)


def _by_fetch(messages: DataFrame, vectors: DataFrame, columns: list[str], deleted: bool) -> DataFrame:
    """As ``_by_join``, for vectors of any size: they are written by file name, and tasks read those of their files."""
    folder = f"{work_dir(messages.sparkSession)}/vectors-{uuid.uuid4().hex}"
    vectors.withColumn("part", F.sha2("file", 256)).write.mode("overwrite").partitionBy("part").parquet(folder)
    row = F.col("_metadata.row_index")
    here = messages.select(*columns, F.sha2(F.col("_metadata.file_path"), 256).alias("__part"), row.alias("__row"))
    n = len(columns)

    def run(batches):
        store, root = open_folder(folder)
        part, blocks = None, {}
        for batch in batches:
            parts, rows = batch.column(n).dictionary_encode(), batch.column(n + 1).to_numpy(zero_copy_only=False).astype(np.int64)
            codes = parts.indices.to_numpy(zero_copy_only=False)
            gone = np.zeros(len(rows), dtype=bool)
            for code, name in enumerate(parts.dictionary.to_pylist()):
                if name != part:
                    part, path, blocks = name, f"{root}/part={name}", {}
                    if store.get_file_info(path).type == fs.FileType.Directory:
                        t = pq.read_table(path, filesystem=store, columns=["block", "words"])
                        blocks = {b: np.array(w, dtype=np.int64) for b, w in zip(t["block"].to_pylist(), t["words"].to_pylist())}
                mine = np.nonzero(codes == code)[0]
                for b in np.unique(rows[mine] >> BLOCK_BITS).tolist():
                    words = blocks.get(b)
                    if words is not None:
                        at = mine[rows[mine] >> BLOCK_BITS == b]
                        low = rows[at] & ((1 << BLOCK_BITS) - 1)
                        gone[at] = (words[low >> 6] >> (low & 63)) & 1 == 1
            yield batch.select(list(range(n))).filter(pa.array(gone if deleted else ~gone))

    return here.mapInArrow(run, messages.select(*columns).schema)


def repeated_messages(messages: DataFrame, order: tuple[str, ...] = ("delivered_at", "batch_no"), limit: int = BROADCAST_BYTES) -> DataFrame:
    """``event_id`` of every message delivered more than once, in its one spelling: the identifiers of the rows that the deletion vectors delete."""
    vectors, fit = _vectors(messages, order, limit)
    gone = (_by_join if fit else _by_fetch)(messages, vectors, ["event_id"], True)
    return gone.select(message_key(F.col("event_id")).alias("event_id")).distinct()
