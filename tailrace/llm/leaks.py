"""Evaluation passages inside training texts: pigeonhole edit matching.

Each item is split into pieces of ``PIECE`` words, one more than the word edits it may suffer. A text with
the item in it, with no more edits than that, has some piece unharmed; so has every text that holds
``RUN`` words of the item in a row, since a run of 2 x PIECE - 1 words covers a whole piece. All pieces of a block of
items are looked up at once by an Aho-Corasick automaton. Around each hit, Myers' bit-parallel algorithm
finds the least number of word edits between a stretch of the text and the item, and between a stretch of the text
and any ``RUN`` words in a row of the item that hold the piece: none means that they stand in the text as they are.
The longest run of words in common through the hit is told along.

Texts are read once per block of items and never shuffled. A block holds ``BLOCK_WORDS`` words of items,
which bounds the automaton; any number of items is worked off in blocks.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.llm.words import words

RUN = 13
PIECE = (RUN + 1) // 2
BLOCK_WORDS = 200_000

_FOUND = "doc_id bigint, item_id bigint, run int, edits int, run_edits int, item_words int"


def pieces(ws: list[str]) -> list[tuple[int, list[str]]]:
    """(position, words) of the pieces of an item: one after the other, the last one from its end; a shorter item is one piece."""
    if len(ws) <= PIECE:
        return [(0, ws)] if ws else []
    at = list(range(0, len(ws) - PIECE + 1, PIECE))
    if at[-1] != len(ws) - PIECE:
        at.append(len(ws) - PIECE)
    return [(a, ws[a : a + PIECE]) for a in at]


def myers(pattern: list[str], text: list[str]) -> int:
    """Least number of word insertions, deletions and replacements between ``pattern`` and any stretch of ``text``."""
    m = len(pattern)
    if not m:
        return 0
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        eq[w] = eq.get(w, 0) | 1 << i
    pv, mv, score, best = full, 0, m, m
    for w in text:
        e = eq.get(w, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        best = min(best, score)
    return best


def common_run(item: list[str], text: list[str], at_item: int, at_text: int, length: int) -> int:
    """Length of the run of equal words that contains the hit."""
    a, b = at_item, at_text
    while a and b and item[a - 1] == text[b - 1]:
        a, b = a - 1, b - 1
    x, y = at_item + length, at_text + length
    while x < len(item) and y < len(text) and item[x] == text[y]:
        x, y = x + 1, y + 1
    return x - a


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = {i: ws for i, ws in ((i, words(t or "")) for i, t in items) if ws}
        where: dict[str, list[tuple[int, int, int]]] = {}
        for i, ws in self.items.items():
            for at, piece in pieces(ws):
                where.setdefault(" " + " ".join(piece) + " ", []).append((i, at, len(piece)))
        self.automaton = ahocorasick.Automaton()
        for key, spots in where.items():
            self.automaton.add_word(key, (len(key), spots))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str) -> dict[int, tuple[int, int, int | None]]:
        """For each item with a hit: (longest run in common, least edits to the item, least edits to ``RUN`` of its words or None if it has fewer)."""
        if self.empty:
            return {}
        ws = words(text)
        line = " " + " ".join(ws) + " "
        starts: list[int] = []
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for end, (size, spots) in self.automaton.iter(line):
            if not starts:  # where each word begins, laid out once
                starts = list(accumulate((len(w) + 1 for w in ws), initial=0))
            at_text = bisect_left(starts, end - size + 1)
            for i, at_item, n in spots:
                hits.setdefault(i, []).append((at_item, at_text, n))
        return {i: self._verify(self.items[i], ws, spots) for i, spots in hits.items()}

    def _verify(self, item: list[str], ws: list[str], spots: list[tuple[int, int, int]]) -> tuple[int, int, int | None]:
        budget = len(pieces(item)) - 1
        run, edits = 0, len(item)
        in_run = RUN if len(item) >= RUN else None
        seen = set()
        for at_item, at_text, n in spots:
            low = at_text - at_item  # where the item would begin
            run = max(run, common_run(item, ws, at_item, at_text, n))
            if edits and low not in seen:  # hits of one place share it
                seen.add(low)
                edits = min(edits, myers(item, ws[max(0, low - budget) : max(0, low + len(item) + budget)]))
            for at in range(max(0, at_item + n - RUN), min(at_item, len(item) - RUN) + 1):
                if not in_run:
                    break
                in_run = min(in_run, myers(item[at : at + RUN], ws[max(0, low + at) : max(0, low + at + RUN)]))
        return run, edits, in_run


def _scan(block):
    kept: list[Matcher] = []

    def run(batches):
        if not kept:
            kept.append(Matcher(block.value))
        m = kept[0]
        for batch in batches:
            rows = []
            for d, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text"))):
                if text:
                    rows += [(d, i, *found, len(m.items[i])) for i, found in m.find(text).items()]
            kinds = {"doc_id": pa.int64(), "item_id": pa.int64(), "run": pa.int32(), "edits": pa.int32(), "run_edits": pa.int32(), "item_words": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds.values())], list(kinds))

    return run


def leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, run, edits, run_edits, item_words`` of every document and item that share a piece.

    ``run``: most words in a row they share; ``edits``: least word edits between the item and any stretch of
    the text; ``run_edits``: the same for ``RUN`` words in a row of the item, null if it has fewer. Null and empty texts and items give no row; equal items are found each; repeated documents give
    repeated rows; empty tables an empty result; further columns are ignored.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out: DataFrame | None = None
    block: list[tuple[int, str]] = []
    held = 0

    def scan(rows):
        found = slim.mapInArrow(_scan(spark.sparkContext.broadcast(rows)), _FOUND)
        return found if out is None else out.unionByName(found)

    for r in items.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        held += r["text"].count(" ") + 1
        if held > BLOCK_WORDS:
            out = scan(block)
            block, held = [], 0
    if block or out is None:
        out = scan(block)
    return out


def leaked_passages(docs: DataFrame, items: DataFrame, max_edit_share: float = 0.1) -> DataFrame:
    """``leaked`` restricted to pairs with a whole run of ``RUN`` words or with edits within ``max_edit_share`` of the item's length."""
    return leaked(docs, items).filter((F.col("run_edits") == 0) | (F.col("edits") <= F.col("item_words") * max_edit_share))
