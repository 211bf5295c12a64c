"""Near-duplicate reports: BagMinHash signatures, banding, and an exact check of every candidate pair.

Only the pages' own reports are compared (template lines are put aside first). A report is the bag of its runs of five
words. It is signed by its counted runs and, where runs come back, by its distinct ones too, so that a passage told
sixteen times finds both the text that tells it fifteen times and the one that tells it once. What shares a band is
checked: ``overlap`` is the multisets' weighted Jaccard similarity, ``likeness`` that of the distinct runs.

Exact copies are folded into classes before anything is paired: signatures and checks are made once per distinct
text. ``pairs`` compares all classes of a band, since its rows are those pairs. ``groups`` gives one row per document
and compares the members of a band with its representative first; only bands whose members are not all in one group
after that are compared in full, across groups, so that no link between two groups is lost and none within one is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tailrace.llm.bagminhash import bag_bands
from tailrace.llm.grouped_splits import components_of
from tailrace.llm.words import shingle_hashes, text_digest, words
from tailrace.llm.wrapper import Templates, induce, label_page, page_nodes
from tailrace.session import materialize

#: 40 bands of 4 registers: a pair of likeness 0.7 is missed with probability (1 - 0.7 ** 4) ** 40, about 2e-5.
REGISTERS, ROWS = 160, 4
#: Bags signed together; bounds the memory of a batch whatever Arrow's batch size.
SIGN_AT_ONCE = 400

_SIGNED = "id string, digest string, text string, bands array<bigint>"


def _sign(templates: Templates | None):
    """Signatures of the pages' reports, or of whole bodies where there are no templates."""

    def bodies(batches):
        if templates is None:
            for batch in batches:
                yield ((i, words(b)) for i, b in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "body"))) if b)
            return
        for rows in templates.sorted_pages(batches, "id", "title", "body"):
            for id_, title, body, wrapper in rows:
                if body:
                    nodes = page_nodes(body)
                    yield ((id_, [w for n, t in zip(nodes, label_page(wrapper, title, nodes, templates.model.value)) if not t for w in words(n.text)]),)

    def signed(ids, texts):
        found = bag_bands([shingle_hashes(ws) for ws in texts], REGISTERS, ROWS)
        keep = [j for j, b in enumerate(found) if b is not None]
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[j] for j in keep], pa.string()), pa.array([text_digest(texts[j]) for j in keep], pa.string()), pa.array([" ".join(texts[j]) for j in keep], pa.string()), pa.array([found[j] for j in keep], pa.list_(pa.int64()))],
            ["id", "digest", "text", "bands"],
        )

    def run(batches):
        ids, texts = [], []
        for rows in bodies(batches):
            for id_, ws in rows:
                if ws:
                    ids.append(id_), texts.append(ws)
                if len(ids) == SIGN_AT_ONCE:
                    yield signed(ids, texts)
                    ids, texts = [], []
        yield signed(ids, texts)

    return run


def similarities(a: list[str], b: list[str]) -> tuple[float, float]:
    """(likeness, overlap) of two texts: Jaccard similarity of their distinct runs, and weighted Jaccard similarity of their counted ones."""
    x, n = np.unique(shingle_hashes(a), return_counts=True)
    y, m = np.unique(shingle_hashes(b), return_counts=True)
    if not len(x) or not len(y):
        return 0.0, 0.0
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    least = int(np.minimum(n[i], m[j]).sum())
    return len(both) / (len(x) + len(y) - len(both)), least / (int(n.sum()) + int(m.sum()) - least)


def _check(least: float):
    def run(batches):
        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "text_a", "text_b"))
            sure = [similarities(s.split(" "), t.split(" ")) for s, t in zip(x, y)]
            keep = [j for j, v in enumerate(sure) if max(v) >= least]
            yield pa.RecordBatch.from_arrays(
                [pa.array([a[j] for j in keep], pa.string()), pa.array([b[j] for j in keep], pa.string()), pa.array([sure[j][0] for j in keep], pa.float64()), pa.array([sure[j][1] for j in keep], pa.float64())],
                ["a", "b", "likeness", "overlap"],
            )

    return run


def _stored_bands(stored: DataFrame) -> DataFrame:
    """``id, bands`` of usable stored signatures: 128 permutations in bands of four. Other sizes and null bands can't be compared. Bands are hashed before anything is shuffled."""
    usable = stored.filter("num_perm = 128 AND band_size = 4 AND band_hashes IS NOT NULL AND document_id IS NOT NULL")
    return usable.select(F.col("document_id").alias("id"), F.transform(F.array_compact("band_hashes"), lambda h: F.xxhash64(h)).alias("bands"))


class NearDuplicates:
    """The links among ``docs`` (``id, source_id, title, body``), read as pairs or groups.

    Two texts are linked if their likeness or their overlap reaches ``least``. ``stored``: optional table of MinHash band
    hashes, whose collisions are further candidates. Null, empty and template-only bodies and texts of under five words
    have no runs of words and so no links, nor have rows without an id; repeated rows of an id count once; an empty
    table gives no links; other columns are ignored.
    """

    def __init__(self, docs: DataFrame, least: float = 0.8, stored: DataFrame | None = None, pages: bool = True):
        self.least = least
        title = F.col("title") if "title" in docs.columns else F.lit(None).cast("string").alias("title")
        source = F.col("source_id") if "source_id" in docs.columns else F.lit(None).cast("string").alias("source_id")
        slim = docs.select(F.col("id").cast("string").alias("id"), source, title, "body").filter("id IS NOT NULL")
        templates = induce(slim) if pages else None
        signed = materialize((templates.pages(slim) if templates else slim).mapInArrow(_sign(templates), _SIGNED), "signed")
        #: ``id, digest``: the class of each document.
        self.members = signed.select("id", "digest").distinct()
        # bands travel with 60 bits of the digest; classes that share them are all checked
        short = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
        banded = signed.select("digest", "bands").dropDuplicates(["digest"]).select(short.alias("k"), "bands")
        if stored is not None:
            banded = banded.unionByName(_stored_bands(stored).join(self.members.select("id", short.alias("k")), "id").select("k", "bands"))
        banded = banded.select("k", F.explode("bands").alias("band"))
        # most bands stand alone; they are dropped before anything is joined
        several = banded.groupBy("band").agg(F.min("k").alias("least_k"), F.max("k").alias("most_k")).filter("least_k < most_k").select("band")
        #: ``k, band``: the classes in bands that several share.
        self.banded = materialize(banded.join(several, "band", "left_semi").distinct(), "shared-bands")
        self._texts = signed.select("digest", "text").dropDuplicates(["digest"]).withColumn("k", short)
        self._links: DataFrame | None = None

    def _verified(self, candidates: DataFrame) -> DataFrame:
        """``a, b, likeness, overlap`` of the candidate pairs ``(a, b)`` of short digests that hold; a and b are whole digests."""
        x = self._texts.select(F.col("k").alias("a"), F.col("digest").alias("digest_a"), F.col("text").alias("text_a"))
        y = self._texts.select(F.col("k").alias("b"), F.col("digest").alias("digest_b"), F.col("text").alias("text_b"))
        both = candidates.join(x, "a").join(y, "b").select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"), "text_a", "text_b")
        return materialize(both.mapInArrow(_check(self.least), "a string, b string, likeness double, overlap double"), "links")

    def links(self) -> DataFrame:
        """``a, b, likeness, overlap`` of every two classes that are linked."""
        if self._links is None:
            x, y = self.banded.select("band", F.col("k").alias("a")), self.banded.select("band", F.col("k").alias("b"))
            self._links = self._verified(x.join(y, "band").filter("a < b").select("a", "b").distinct())
        return self._links

    def pairs(self, measure: str = "likeness") -> DataFrame:
        """``(id_a, id_b)``: every pair of documents whose ``measure`` reaches the threshold, copies among them, smaller id first."""
        x = self.members.select(F.col("digest").alias("a"), F.col("id").alias("x"))
        y = self.members.select(F.col("digest").alias("b"), F.col("id").alias("y"))
        linked = self.links().filter(F.col(measure) >= self.least).select("a", "b").join(x, "a").join(y, "b").select("x", "y")
        copies = x.join(y, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
        return linked.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def _grouped(self, links: DataFrame) -> DataFrame:
        """``k, group``: the smallest digest that each linked class reaches."""
        roots = components_of(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
        known = roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()
        return materialize(self._texts.select("k", "digest").join(known, F.col("digest") == F.col("node")).select("k", "digest", F.col("root").alias("group")), "groups")

    def groups(self) -> DataFrame:
        """One row per document that has a copy or a link: ``id``, ``group_id`` (the smallest class it reaches over links), ``class_id`` (its text's digest) and ``copies`` of that text."""
        star = self.banded.join(self.banded.groupBy("band").agg(F.min("k").alias("a")), "band").filter("k <> a").select("a", F.col("k").alias("b")).distinct()
        star = materialize(star, "stars")
        links = self._verified(star)
        group = self._grouped(links)
        # bands that still hold several groups are compared in full, but for pairs of one group or known from a star
        at = self.banded.join(group.select("k", "group"), "k", "left").select("band", "k", F.coalesce("group", F.col("k").cast("string")).alias("g"))
        split = at.groupBy("band").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.count("*").alias("n")).filter("low < high AND n > 2").select("band")
        at = materialize(at.join(split, "band", "left_semi"), "split-bands")
        x, y = at.select("band", F.col("k").alias("a"), F.col("g").alias("ga")), at.select("band", F.col("k").alias("b"), F.col("g").alias("gb"))
        rest = x.join(y, "band").filter("a < b AND ga <> gb").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
        group = self._grouped(links.unionByName(self._verified(rest)))
        sizes = self.members.groupBy("digest").agg(F.count("*").alias("copies"))
        known = sizes.join(group.select("digest", "group"), "digest", "left").filter("copies > 1 OR group IS NOT NULL")
        return self.members.join(known, "digest").select("id", F.coalesce("group", "digest").alias("group_id"), F.col("digest").alias("class_id"), "copies")
