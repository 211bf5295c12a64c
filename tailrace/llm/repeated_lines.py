"""Lines repeated across one source's documents.

Three passes over the bodies, none of which shuffles a text:

1. every task keeps one mergeable heavy-hitter summary per source (Misra-Gries
   over the set of lines of each document). A summary may lose at most half of
   the share asked for, and says how much it lost; so a line that reaches the
   share is in at least one summary, and its count plus the losses bounds its
   true count from above. No line is missed whatever the number of tasks.
2. the candidates are counted exactly.
3. confirmed lines are marked (or cut out) with the broadcast set of them.

The candidates of a source number at most (lines per document) / (share / 2).
They are broadcast only while they fit; beyond that passes 2 and 3 join by key, with the
same result: both count rows, and rows are marked by a digest of all that decides on them.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.llm.lines import fold_lines
from tailrace.session import materialize

#: Candidate lines that are sent to every executor at most: 16 bytes each, so 16 MB. Beyond it the passes join.
MAX_BROADCAST_LINES = 1_000_000

_SUMMARY = "source_id string, line bigint, docs bigint, lost bigint"


def line_keys(body: str) -> list[int | None]:
    """A 64-bit key for each line, None for lines that never count: without letters, or opening with ``#``."""
    raws = body.split("\n")
    out: list[int | None] = []
    for raw, folded in zip(raws, fold_lines(body)):
        if not folded or raw.lstrip()[:1] == "#":
            out.append(None)
        else:
            h = xxhash.xxh3_64_intdigest(folded)
            out.append(h - (1 << 64) if h >> 63 else h)
    return out


def _batches(batches, *columns):
    for batch in batches:
        yield zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


class Summary:
    """Misra-Gries over documents: ``lost`` bounds what any line's count lacks."""

    def __init__(self) -> None:
        self.counts: Counter[int] = Counter()
        self.docs = self.lines = self.lost = 0

    def add(self, keys: set[int]) -> None:
        self.docs += 1
        self.lines += len(keys)
        self.counts.update(keys)

    def shrink(self, share: float) -> None:
        """Cut down to 4 x lines per document / share counters, as far as half the share allows."""
        room = int(math.ceil(4 * max(1.0, self.lines / max(1, self.docs)) / share))
        if len(self.counts) <= 2 * room:
            return
        by = min(sorted(self.counts.values(), reverse=True)[room], int(share / 2 * self.docs) - self.lost)
        if by > 0:
            self.lost += by
            self.counts = Counter({k: n - by for k, n in self.counts.items() if n > by})

    def spend(self, share: float) -> None:
        """Spend what is left of the allowance, so that little is sent."""
        by = int(share / 2 * self.docs) - self.lost
        if by > 0:
            self.lost += by
            self.counts = Counter({k: n - by for k, n in self.counts.items() if n > by})


def _summarise(share: float):
    def run(batches):
        kept: dict[str, Summary] = {}
        for rows in _batches(batches, "source_id", "body"):
            touched = set()
            for source, body in rows:
                if source is None:
                    continue
                s = kept.get(source)
                if s is None:
                    s = kept[source] = Summary()
                touched.add(source)
                s.add({k for k in line_keys(body) if k is not None} if body else set())
            for source in touched:
                kept[source].shrink(share)
        for source, s in kept.items():
            s.spend(share)
            n = len(s.counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([source] * (n + 1), pa.string()), pa.array([None, *s.counts.keys()], pa.int64()), pa.array([s.docs, *s.counts.values()], pa.int64()), pa.array([s.lost] + [0] * n, pa.int64())],
                ["source_id", "line", "docs", "lost"],
            )

    return run


def _counts(wanted):
    def run(batches):
        seen: Counter[tuple[str, int]] = Counter()
        sets = wanted.value
        for rows in _batches(batches, "source_id", "body"):
            for source, body in rows:
                lines = sets.get(source)
                if lines and body:
                    seen.update((source, k) for k in lines.intersection(line_keys(body)))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in seen], pa.string()), pa.array([k for _, k in seen], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["source_id", "line", "docs"])

    return run


_LINES = "row string, id string, source_id string, line_no bigint, line bigint, first boolean"


def _row_key(id_: str | None, source: str, body: str) -> str:
    """One key for equal rows: what recurs in one of them recurs in all."""
    h = xxhash.xxh3_128(body.encode("utf-8", "surrogatepass"))
    for part in (source, id_):
        h.update(b"\0" if part is None else b"\1" + part.encode("utf-8", "surrogatepass") + b"\0")
    return h.hexdigest()


def _exploded(batches):
    """Every line that may recur; ``first`` marks the first line of its kind in a row, so that their number is the number of rows."""
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    for rows in _batches(batches, "id", "source_id", "body"):
        out = []
        for id_, source, body in rows:
            if source is None or not body:
                continue
            key, met = _row_key(id_, source, body), set()
            for no, k in enumerate(line_keys(body), 1):
                if k is not None:
                    out.append((key, id_, source, no, k, k not in met))
                    met.add(k)
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], ["row", "id", "source_id", "line_no", "line", "first"])


def _marked(wanted):
    def run(batches):
        sets = wanted.value
        for rows in _batches(batches, "id", "source_id", "body"):
            ids, numbers = [], []
            for id_, source, body in rows:
                lines = sets.get(source)
                if lines and body:
                    for no, k in enumerate(line_keys(body), 1):
                        if k in lines:
                            ids.append(id_), numbers.append(no)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int64())], ["id", "line_no"])

    return run


def _as_sets(rows) -> dict[str, frozenset[int]]:
    out: dict[str, set[int]] = {}
    for r in rows:
        out.setdefault(r["source_id"], set()).add(r["line"])
    return {k: frozenset(v) for k, v in out.items()}


def candidate_lines(docs: DataFrame, share: float = 0.2, min_docs: int = 4) -> tuple[DataFrame, DataFrame]:
    """Pass 1: (``source_id, line`` that may recur, ``source_id, n_docs, least`` per source)."""
    found = materialize(docs.select("source_id", "body").mapInArrow(_summarise(share), _SUMMARY), "line-summaries")
    totals = (
        found.filter("line IS NULL").groupBy("source_id").agg(F.sum("docs").alias("n_docs"), F.sum("lost").alias("lost"))
        .withColumn("least", F.greatest(F.lit(float(min_docs)), F.col("n_docs") * share))
    )
    counted = found.filter("line IS NOT NULL").groupBy("source_id", "line").agg(F.sum("docs").alias("docs"))
    kept = counted.join(totals, "source_id").filter("docs + lost >= least")
    return kept.select("source_id", "line"), totals.select("source_id", "n_docs", "least")


def repeated_lines(docs: DataFrame, share: float = 0.2, min_docs: int = 4) -> tuple[DataFrame, dict | None]:
    """The confirmed lines ``(source_id, line, docs)``; also as sets by source when they may be broadcast, else None.

    A line recurs if it stands in at least ``min_docs`` documents and at least ``share`` of the
    documents (rows, also those without a body) of its source. Rows without a source belong to none.
    """
    candidates, totals = candidate_lines(docs, share, min_docs)
    candidates = materialize(candidates, "line-candidates")
    spark = docs.sparkSession
    if candidates.count() <= MAX_BROADCAST_LINES:
        wanted = spark.sparkContext.broadcast(_as_sets(candidates.toLocalIterator()))
        exact = docs.select("source_id", "body").mapInArrow(_counts(wanted), "source_id string, line bigint, docs bigint").groupBy("source_id", "line").agg(F.sum("docs").alias("docs"))
    else:
        exact = _slim(docs).mapInArrow(_exploded, _LINES).filter("first").select("source_id", "line").join(candidates, ["source_id", "line"], "left_semi").groupBy("source_id", "line").agg(F.count("*").alias("docs"))
    confirmed = materialize(exact.join(totals, "source_id").filter("docs >= least").select("source_id", "line", "docs"), "line-confirmed")
    return confirmed, _as_sets(confirmed.toLocalIterator()) if confirmed.count() <= MAX_BROADCAST_LINES else None


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("id").cast("string").alias("id"), "source_id", "body")


def repeated_line_rows(docs: DataFrame, share: float = 0.2, min_docs: int = 4) -> DataFrame:
    """``(id, line_no)`` of every line that recurs in its source; ``line_no`` counts all lines of the body from 1.

    Null and empty bodies give no row, equal rows of a document count as documents of their own and rows without an id
    like any other, whether lines are broadcast or joined; an empty table gives an empty result; further columns are ignored.
    """
    confirmed, sets = repeated_lines(docs, share, min_docs)
    if sets is not None:
        return _slim(docs).mapInArrow(_marked(docs.sparkSession.sparkContext.broadcast(sets)), "id string, line_no bigint")
    return _slim(docs).mapInArrow(_exploded, _LINES).join(confirmed, ["source_id", "line"], "left_semi").select("id", "line_no")


def strip_repeated_lines(docs: DataFrame, share: float = 0.2, min_docs: int = 4) -> DataFrame:
    """``docs`` with ``body`` freed of the lines that recur in its source; all other columns and rows stay."""
    confirmed, sets = repeated_lines(docs, share, min_docs)
    if sets is None:
        marked = _slim(docs).mapInArrow(_exploded, _LINES).join(confirmed, ["source_id", "line"], "left_semi")
        # at most as many as the body has lines
        gone = marked.groupBy(F.col("row").alias("_gone_row")).agg(F.collect_set("line_no").alias("_gone"))
        cut = F.array_join(F.filter(F.split("body", "\n", -1), lambda _, i: ~F.array_contains("_gone", i.cast("long") + 1)), "\n")

        @F.pandas_udf("string")
        def row_keys(ids, sources, bodies):
            return bodies.__class__([_row_key(i, s, b) if s is not None and b else None for i, s, b in zip(ids, sources, bodies)], index=bodies.index, dtype=object)

        keyed = docs.withColumn("_row", row_keys(F.col("id").cast("string"), "source_id", "body"))
        return keyed.join(gone, F.col("_row") == F.col("_gone_row"), "left").withColumn("body", F.when(F.col("_gone").isNull(), F.col("body")).otherwise(cut)).select(*docs.columns)
    wanted = docs.sparkSession.sparkContext.broadcast(sets)

    @F.pandas_udf("string")
    def cut_lines(sources, bodies):
        def one(source, body):
            lines = wanted.value.get(source)
            return "\n".join(raw for raw, k in zip(body.split("\n"), line_keys(body)) if k not in lines) if lines and body else body

        return bodies.__class__([one(s, b) for s, b in zip(sources, bodies)], index=bodies.index, dtype=object)

    return docs.withColumn("body", cut_lines("source_id", "body"))
