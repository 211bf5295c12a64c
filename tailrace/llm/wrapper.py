"""Page boilerplate against main content, by wrapper induction.

The pages are plain text. A page's tree has its lines under the root, in order, and runs of items under the line above
them. Pages of one source are generalised into a wrapper, a tree of the same form:

* constant nodes: lines whose folded text stands in many pages of the source (and, if in fewer than a fifth of them, far
  more often than elsewhere). They are found by counting, since sites put notices anywhere, and are ordered by their mean place; an
  item that mostly hangs from another constant is its child.
* lines that begin alike in many pages (``Tags: ...``) are one constant node with a slot in it.
* slots, the gaps after constant nodes: for each the pages are counted in which varying short lines follow (teasers, bylines) or lines
  of a report. A slot is open if short lines are the rule.

Simple tree matching aligns a page's tree with its source's wrapper. Constants, aligned or moved, are template. A varying
line is judged by what it hangs from: an item by the line above its run and by what items and titles open with (learned from
runs whose parent is certain), a short line by the slot it is in. A heading is content, but for one that only titles of other pages hang from
(``## Related``). Sentences that stand unchanged in pages of several sources are constants of all templates; those that
always follow report lines are the report's own. Where none of this decides, the kind of line does: short lines are
template in sources that have a wrapper. Without a wrapper nothing but the sentences of all sources is template.

The title line of a page without a title is looked for below the last aligned node of its head (all before the first certain line).
Pages that tell the same report count once (``_reports``), whatever their titles.

Passes 1 and 2 count nodes per task and source, pass 3 labels; no text is shuffled, but hashes of each page's candidates are.
Wrappers are written to the shared folder in buckets of sources, and each task fetches those of the sources it meets: a join
on the source without a shuffle, of any number of sources and in one pass. Only constants of the whole corpus are sent to all; shares of pages bound their number.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tailrace.llm.lines import ITEM, NAME, SENTENCES, B, C, H, L, P, T, fold, fold_lines, kind_of, lead
from tailrace.llm.repeated_lines import Summary
from tailrace.session import materialize, open_folder, work_dir

SLOT = re.compile(r"\d")
#: Share of a source's pages from which a node is constant there by itself.
CONSTANT_SHARE = 0.2
#: Share from which it is constant if it is also this many times as frequent as in the whole corpus.
LOCAL_SHARE, LIFT, LOCAL_PAGES = 0.02, 3.0, 5
#: Share of all pages from which a sentence, the opening of an item or of a title is a constant of the corpus.
COMMON_SHARE = 0.001
MIN_PAGES = 3
#: Pages that count for a share, at least, against all pages of the source.
MIN_SHARE_OF_PAGES = 0.1
#: Share of a page's lines that come back, from which it may be a copy; it is one if it also tells less than this share of what the source's pages tell beside such lines.
COPIED_SHARE = 0.5
#: Share of the pages of one title with the same remainder, beyond which they tell one report.
RETOLD_SHARE = 1 / 3
#: A common sentence is the report's own if this share of its uses follows a line of the report.
SIGNOFF_RATE = 0.8
#: Nodes of wrappers in one bucket, on average, and buckets a task keeps at once.
BUCKET_ROWS, KEPT_BUCKETS = 200_000, 4


def _key(folded: bytes) -> int:
    return xxhash.xxh3_64_intdigest(folded)


@dataclass(eq=False)
class Node:
    no: int
    kind: str
    key: int
    text: str
    folded: bytes
    children: list[Node] = field(default_factory=list)


def page_nodes(body: str) -> list[Node]:
    """The non-blank lines of a page, in order; items are also children of the line above their run."""
    out: list[Node] = []
    above = None
    for no, (raw, folded) in enumerate(zip(body.split("\n"), fold_lines(body)), 1):
        text = raw.strip()
        if text:
            n = Node(no, kind_of(raw, text), _key(folded), text, folded)
            if n.kind != L:
                above = n
            elif above is not None:
                above.children.append(n)
            out.append(n)
    return out


@dataclass(eq=False)
class Part:
    """A node of a wrapper."""

    key: int
    children: list[Part] = field(default_factory=list)


@dataclass
class Wrapper:
    """What the pages of a source have in common: its constants, their tree, and the constants that varying short lines follow."""

    keys: frozenset[int] = frozenset()
    parts: list[Part] = field(default_factory=list)
    open: frozenset[int] = frozenset()


NO_WRAPPER = Wrapper()


def tree_match(page: list, template: list) -> tuple[int, list[tuple]]:
    """Simple tree matching of two lists of trees (``key, children``): the size of the largest matching that keeps order and descent, and its pairs.

    Roots match only if their keys are equal; children are matched below matched roots.
    """
    known = {t.key for t in template}
    page = [p for p in page if p.key in known]
    m, n = len(page), len(template)
    if not m or not n:
        return 0, []
    below = {(i, j): tree_match(p.children, t.children) for i, p in enumerate(page) for j, t in enumerate(template) if p.key == t.key}
    best = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 + below[i, j][0] if (i, j) in below else 0)
    pairs, i, j = [], 0, 0
    while i < m and j < n:
        if (i, j) in below and best[i][j] == best[i + 1][j + 1] + 1 + below[i, j][0]:
            pairs.append((page[i], template[j]))
            pairs += below[i, j][1]
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return best[0][0], pairs


_CERTAIN = (H, T, C, P, L)


def opening_key(text: str) -> int | None:
    """What a short line begins with, as a node with a slot: its first word and the punctuation at it; none for names, numbers and single words."""
    parts = text.split(None, 1)
    if len(parts) < 2 or SLOT.search(parts[0]) or NAME.search(parts[0]):
        return None
    return _key(parts[0].lower().encode("utf-8", "surrogatepass")) ^ 2


def countable(nodes: list[Node]) -> tuple[set[int], set[int]]:
    """The distinct nodes of a page that may be constants of its source, and those that may be constants of the corpus."""
    local = {n.key for n in nodes if n.kind != H} | {k for n in nodes if n.kind == B and (k := opening_key(n.text)) is not None}
    common = {n.key for n in nodes if n.kind == P and without_slots(n.text)} | {k for n in nodes if n.kind == P for k in last_sentence(n.text)}
    return local, common


def without_slots(text: str) -> bool:
    """Whether a sentence has neither numbers nor compound names: only then can it be the same for all sources."""
    return not (SLOT.search(text) or NAME.search(text))


def last_sentence(text: str) -> tuple[int, ...]:
    """The key of the last sentence of a line of several sentences, if that has no slots and the line but two compound words (a site's own name, say)."""
    parts = SENTENCES.split(text)
    if SLOT.search(text) or not without_slots(parts[-1]) or len(NAME.findall(text)) > 2:
        return ()
    return (_key(" ".join(parts[-1].lower().split()).encode("utf-8", "surrogatepass")) ^ 1,) if len(parts) > 1 else ()


@dataclass
class Model:
    """What holds for all sources."""

    common: frozenset[int] = frozenset()
    signoffs: frozenset[int] = frozenset()
    item_leads: frozenset[str] = frozenset()
    title_leads: frozenset[str] = frozenset()


def roots_of(nodes: list[Node]) -> list[Node]:
    """The nodes right below the root: all but items that hang from a line."""
    first = next((i for i, n in enumerate(nodes) if n.kind != L), len(nodes))
    return [n for i, n in enumerate(nodes) if n.kind != L or i < first]


def _is_sidebar(heading: int, nodes: list[Node], model: Model) -> bool:
    """Whether what stands under a heading, up to the next line that isn't an item, opens like titles and not like a report's items."""
    leads = [lead(n.text) for n in nodes[heading].children]
    return bool(leads) and all(x in model.title_leads and x not in model.item_leads for x in leads)


def label_page(wrapper: Wrapper, title: str | None, nodes: list[Node], model: Model) -> list[bool]:
    """For each node whether it is template (True) or content."""
    own = fold(title) if title else b""
    _, pairs = tree_match(roots_of(nodes), wrapper.parts)
    aligned = {id(n) for n, _ in pairs}
    out: list[bool | None] = []
    for i, n in enumerate(nodes):
        if n.kind == H:
            out.append(_is_sidebar(i, nodes, model))
        elif (id(n) in aligned or n.key in wrapper.keys) and not (own and n.folded == own) and not (n.kind == L and lead(n.text) in model.item_leads):
            out.append(True)
        elif n.kind == P:
            if n.key in model.common:
                out.append(n.key not in model.signoffs)
            else:
                out.append(any(k in model.common for k in last_sentence(n.text)))
        elif n.kind in (T, C):
            out.append(False)
        else:
            out.append(None)
    parent_is_content = True
    for i, n in enumerate(nodes):  # items hang from the line above their run
        if n.kind != L:
            parent_is_content = out[i] is False
        elif out[i] is None and wrapper.keys:
            opening = lead(n.text)
            out[i] = opening not in model.item_leads and not (parent_is_content and opening not in model.title_leads)
    head = next((i for i, v in enumerate(out) if v is False), len(out))
    if own:
        at = next((i for i, n in enumerate(nodes) if out[i] is None and n.folded == own), None)
    else:
        below = max((i for i, n in enumerate(nodes[:head]) if id(n) in aligned), default=-1)
        at = next((i for i in range(head - 1, below, -1) if out[i] is None), None)
        if at is not None and (lead(nodes[at].text) not in model.title_leads or ITEM.match(nodes[at].text)):
            at = None
    if at is not None:
        out[at] = False
    slot = False
    for i, n in enumerate(nodes):  # short lines are in the slot of the constant above them
        if out[i] is None:
            begins = opening_key(n.text)
            out[i] = slot or (begins in wrapper.keys and lead(n.text) not in model.title_leads) or bool(wrapper.keys)
        else:
            slot = out[i] and n.key in wrapper.open
    return out


# -- the three passes -------------------------------------------------------

_ROWS = "what string, source_id string, node bigint, word string, n bigint, m bigint, title bigint, rest bigint, nodes array<bigint>"


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _rows(rows):
    """An Arrow batch of rows; the last three columns may be left out."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 4, pa.list_(pa.int64())]
    cols = list(zip(*((*r, None, None, None)[:9] for r in rows))) if rows else [[]] * 9
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["what", "source_id", "node", "word", "n", "m", "title", "rest", "nodes"])


def _pages(batches, *columns):
    for batch in batches:
        yield zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def _summarise(batches):
    """Pass 1: heavy-hitter summaries of nodes, one per source and one of the corpus."""
    local: dict[str, Summary] = {}
    common = Summary()
    pages: Counter = Counter()
    for rows in _pages(batches, "source_id", "body"):
        for source, body in rows:
            pages[source] += 1
            mine, shared = countable(page_nodes(body)) if body else (set(), set())
            common.add(shared)
            if source is not None:
                local.setdefault(source, Summary()).add(mine)
        common.shrink(COMMON_SHARE)
        for s in local.values():
            s.shrink(LOCAL_SHARE)
    common.spend(COMMON_SHARE)
    yield _rows([("pages", s, None, None, n, 0) for s, n in pages.items()])
    yield _rows([("common", None, None, None, 0, common.lost)] + [("common", None, _signed(k), None, n, 0) for k, n in common.counts.items()])
    for source, s in local.items():
        s.spend(LOCAL_SHARE)
        yield _rows([("local", source, None, None, 0, s.lost)] + [("local", source, _signed(k), None, n, 0) for k, n in s.counts.items()])


def _count(templates: Templates):
    """Pass 2: exact counts of the candidates by source (m: right after a line of the report), their places, parents and slots, and of the openings of items and titles; of each page its candidates and what tells its report from others (n: lines of its remainder, m: whether much of it comes back)."""

    def run(batches):
        common = templates.model.value
        counts: Counter = Counter()
        after: Counter = Counter()
        words: Counter = Counter()
        places: Counter = Counter()
        parents: Counter = Counter()
        slots: Counter = Counter()
        marked: Counter = Counter()
        ends: set[int] = set()
        for rows in templates.sorted_pages(batches, "source_id", "title", "body"):
            pages = []
            for source, title, body, wrapper in rows:
                if title and title.strip():
                    words["title", lead(title.strip())] += 1
                if not body:
                    continue
                nodes = page_nodes(body)
                mine, shared = countable(nodes)
                again, rest = remainder(nodes, wrapper.keys, common)
                seen = {k for k in mine if k in common or k in wrapper.keys} | {k for k in shared if k in common}
                counts.update((source, k) for k in seen)
                named = " ".join(title.lower().split()) if title else ""
                pages.append(("page", source, None, None, len(rest), int(again), _signed(_key(named.encode("utf-8", "surrogatepass"))) if named else None, _signed(min(rest, default=0)), [_signed(k) for k in seen]))
                ends.update(k for k in shared - mine if k in common)
                own = fold(title) if title else b""
                before = parent = ""
                above = None
                for i, n in enumerate(nodes):
                    if above is not None and above.key in wrapper.keys and n.key not in wrapper.keys and not (own and n.folded == own):
                        slots[source, above.key, n.kind in (B, L)] += 1
                    if n.key in seen:
                        after[source, n.key] += before in _CERTAIN
                        places[source, n.key] += 1000 * i // len(nodes)
                        seen.discard(n.key)
                    for c in n.children:
                        if c.key in wrapper.keys and n.key in wrapper.keys:
                            parents[source, c.key, n.key] += 1
                    if n.kind == P and n.key in common:
                        for k in last_sentence(n.text):
                            after[source, k] += 1
                    if n.kind == L:
                        if parent in (H, B) and n.key not in wrapper.keys:
                            words["item", lead(n.text)] += 1
                            marked["item", lead(n.text)] += parent == H
                    else:
                        parent = n.kind
                    before, above = n.kind, n
            yield _rows(pages)
        yield _rows([("node", s, _signed(k), "last" if k in ends else None, n, after[s, k]) for (s, k), n in counts.items()])
        yield _rows([("place", s, _signed(k), None, n, 0) for (s, k), n in places.items()])
        yield _rows([("parent", s, _signed(k), None, n, 0, _signed(up)) for (s, k, up), n in parents.items()])
        yield _rows([("slot", s, _signed(k), None, n if short else 0, 0 if short else n) for (s, k, short), n in slots.items()])
        yield _rows([(what, None, None, w, n, marked[what, w]) for (what, w), n in words.items()])

    return run


def remainder(nodes: list[Node], local, common) -> tuple[bool, set[int]]:
    """Whether much of a page comes back elsewhere, and the lines of a report on it that don't. A short page without such lines is known by its other lines."""
    own, parent = [], B
    for n in nodes:
        if n.kind in (P, T, C) or (n.kind == L and parent != B):
            own.append(n)
        if n.kind != L:
            parent = n.kind
    back = [n.key in local or n.key in common for n in own if n.kind != L]
    rest = {n.key for n in own if n.key not in local and n.key not in common}
    if not rest and len(own) < 5:
        rest = {n.key for n in nodes if n.key not in local and n.key not in common}
    return len(back) >= 5 and sum(back) >= COPIED_SHARE * len(back), rest


def _reports(pages: DataFrame) -> DataFrame:
    """``source_id, report, nodes``: every page with the report it tells, equal for copies and retellings of one.

    Copies say nothing of a template, so a node counts once for each report it stands with. Pages that tell little
    beside lines that come back, for their source, are one report (0). Pages of one title are if their remainders
    agree or, against other titles of the source, are small. All others are told apart by their remainder.
    """
    # what pages tell, by source and by title
    titled = pages.groupBy("source_id", "title").agg(F.sum("n").alias("told"), F.count("*").alias("k"))
    whole = pages.groupBy(F.col("source_id").alias("s")).agg(F.sum("n").alias("all_told"), F.count("*").alias("all_k"))
    little = F.col("told") / F.col("k") < COPIED_SHARE * (F.col("all_told") - F.col("told")) / (F.col("all_k") - F.col("k"))
    small = titled.filter("title IS NOT NULL AND k > 1").join(whole, F.expr("source_id <=> s")).filter((F.col("all_k") > F.col("k")) & little)
    small = small.select(F.col("source_id").alias("of"), F.col("title").alias("small"))
    copy = (F.col("rest") == 0) | ((F.col("m") == 1) & (F.col("n") < COPIED_SHARE * F.col("all_told") / F.col("all_k")))
    one = pages.join(whole, F.expr("source_id <=> s")).withColumn("copy", copy)
    agreeing = one.filter("title IS NOT NULL AND NOT copy").groupBy(F.col("title").alias("agreeing"), "rest").agg(F.count("*").alias("k")).groupBy("agreeing").agg(F.max("k").alias("most"), F.sum("k").alias("k"))
    agreeing = agreeing.filter((F.col("most") > 1) & (F.col("most") > RETOLD_SHARE * F.col("k"))).select("agreeing")
    one = one.join(small, F.expr("source_id <=> of AND title = small"), "left").join(agreeing, F.expr("title = agreeing"), "left")
    report = F.when(F.col("copy"), F.lit(0).cast("long")).when(F.coalesce("small", "agreeing").isNotNull(), F.col("title")).otherwise(F.col("rest"))
    return one.select("source_id", report.alias("report"), "nodes")


def _label(templates: Templates):
    def run(batches):
        for rows in templates.sorted_pages(batches, "id", "title", "body"):
            ids, numbers = [], []
            for id_, title, body, wrapper in rows:
                if body:
                    nodes = page_nodes(body)
                    for n, template in zip(nodes, label_page(wrapper, title, nodes, templates.model.value)):
                        if template:
                            ids.append(id_), numbers.append(n.no)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(numbers, pa.int64())], ["id", "line_no"])

    return run


_BUCKETS: dict[tuple[str, int], dict[str, Wrapper]] = {}


class Templates:
    """The wrappers of all sources, written in buckets of sources to the shared folder, and what holds for all of them (``model``, a broadcast)."""

    def __init__(self, nodes: DataFrame, model):
        """``nodes``: ``source_id, node, place, parent, open``; constants without a place are no part of the tree."""
        self.buckets = nodes.count() // BUCKET_ROWS + 1
        self.folder = f"{work_dir(nodes.sparkSession)}/wrappers-{uuid.uuid4().hex}"
        nodes.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(self.folder)
        self.model = model

    def _bucket(self) -> Column:
        return F.coalesce(F.pmod(F.xxhash64("source_id"), F.lit(self.buckets)), F.lit(0))

    def pages(self, docs: DataFrame) -> DataFrame:
        """``docs`` with the number of the bucket that has their source's wrapper."""
        return docs.withColumn("__bucket", self._bucket())

    def wrapper(self, source: str | None, bucket: int) -> Wrapper:
        if source is None:
            return NO_WRAPPER
        at = (self.folder, bucket)
        if at not in _BUCKETS:
            while len(_BUCKETS) >= KEPT_BUCKETS:
                _BUCKETS.pop(next(iter(_BUCKETS)))
            _BUCKETS[at] = self._fetch(bucket)
        return _BUCKETS[at].get(source, NO_WRAPPER)

    def _fetch(self, bucket: int) -> dict[str, Wrapper]:
        store, root = open_folder(self.folder)
        path = f"{root}/bucket={bucket}"
        if store.get_file_info(path).type != fs.FileType.Directory:
            return {}
        by: dict[str, list] = {}
        for r in pq.read_table(path, filesystem=store, columns=["source_id", "node", "place", "parent", "open"], partitioning=None).to_pylist():
            by.setdefault(r["source_id"], []).append(r)
        return {s: _wrapper(rows) for s, rows in by.items()}

    def sorted_pages(self, batches, *columns):
        """Of each batch the values of ``columns`` and the wrapper, row by row, in the order of buckets."""
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*columns, "source_id", "__bucket")]
            order = sorted(range(batch.num_rows), key=cols[-1].__getitem__)
            yield ((*(c[i] for c in cols[:-2]), self.wrapper(cols[-2][i], cols[-1][i])) for i in order)


def _wrapper(rows: list[dict]) -> Wrapper:
    rows = sorted(rows, key=lambda r: (r["place"] if r["place"] is not None else -1.0, r["node"]))
    parts = {r["node"]: Part(_unsigned(r["node"])) for r in rows if r["place"] is not None}
    roots = []
    for r in rows:
        if r["node"] in parts:
            home = parts.get(r["parent"])
            (roots if home is None else home.children).append(parts[r["node"]])
    return Wrapper(frozenset(_unsigned(r["node"]) for r in rows), roots, frozenset(_unsigned(r["node"]) for r in rows if r["open"]))


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("id").cast("string").alias("id"), "source_id", F.col("title"), "body")


def _unsigned(k: int) -> int:
    return k & 0xFFFFFFFFFFFFFFFF


def induce(docs: DataFrame) -> Templates:
    """The wrappers of all sources, from every page of ``docs``."""
    slim = _slim(docs)
    send = docs.sparkSession.sparkContext.broadcast
    first = materialize(slim.select("source_id", "body").mapInArrow(_summarise, _ROWS), "nodes")
    sizes = materialize(first.filter("what = 'pages'").groupBy("source_id").agg(F.sum("n").alias("pages")), "pages")
    total = sizes.agg(F.sum("pages")).head()[0] or 0
    enough = float(max(MIN_PAGES, COMMON_SHARE * total))
    lost = first.filter("node IS NULL AND what <> 'pages'").groupBy("what", F.col("source_id").alias("s")).agg(F.sum("m").alias("lost")).withColumnRenamed("what", "w")
    counted = first.filter("node IS NOT NULL").groupBy("what", "source_id", "node").agg(F.sum("n").alias("n"))
    counted = counted.join(lost, F.expr("what = w AND source_id <=> s")).join(sizes, "source_id", "left")
    least = F.when(F.col("what") == "common", enough).otherwise(F.greatest(F.lit(float(MIN_PAGES)), F.col("pages") * LOCAL_SHARE))
    candidates = materialize(counted.filter(F.col("n") + F.col("lost") >= least).select("what", "source_id", "node"), "node-candidates")
    common = frozenset(_unsigned(r["node"]) for r in candidates.filter("what = 'common'").toLocalIterator())
    bare = F.lit(None)
    wanted = Templates(candidates.filter("what = 'local'").select("source_id", "node", bare.cast("double").alias("place"), bare.cast("long").alias("parent"), bare.cast("boolean").alias("open")), send(common))
    every = materialize(wanted.pages(slim).select("source_id", "title", "body", "__bucket").mapInArrow(_count(wanted), _ROWS), "node-counts")
    reports = materialize(_reports(every.filter("what = 'page'")), "reports")
    standing = reports.select("source_id", "report", F.explode("nodes").alias("node"))
    nodes = every.filter("what = 'node'").groupBy("source_id", "node").agg(F.sum("n").alias("pages_n"), F.sum("m").alias("m"), F.max("word").alias("last"))
    over_all = nodes.groupBy("node").agg(F.sum("pages_n").alias("pages_n"), F.sum("m").alias("all_m"), F.count("*").alias("sources"), F.max("last").alias("last"))
    over_all = materialize(over_all.join(standing.groupBy("node").agg(F.countDistinct("report").alias("all_n")), "node"), "nodes-of-all")
    # a last sentence that always ends one and the same line is that line's, not a constant of notices
    shared = over_all.filter((F.col("all_n") >= enough) & (F.col("sources") >= 2) & ~(F.col("last").isNotNull() & (F.col("all_m") >= 0.5 * F.col("pages_n")))).collect()
    signoffs = frozenset(_unsigned(r["node"]) for r in shared if r["all_m"] >= SIGNOFF_RATE * r["pages_n"])
    openings = every.filter("what IN ('item', 'title')").groupBy("what", "word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).filter(F.col("n") >= enough).collect()
    whole = {r["what"]: r["n"] for r in every.filter("what IN ('item', 'title')").groupBy("what").agg(F.sum(F.when(F.col("what") == "item", F.col("m")).otherwise(F.col("n"))).alias("n")).collect()}
    titled = {r["word"]: r["n"] / (whole["title"] or 1) for r in openings if r["what"] == "title"}
    # what opens titles more often than items below headings isn't a report's item
    item_leads = frozenset(r["word"] for r in openings if r["what"] == "item" and r["n"] < 2 * r["m"] and r["m"] / (whole["item"] or 1) >= titled.get(r["word"], 0.0))
    of_all = Model(
        common=frozenset(_unsigned(r["node"]) for r in shared),
        signoffs=signoffs,
        item_leads=item_leads,
        title_leads=frozenset(w for w, share in titled.items() if share >= 0.002),
    )
    kept = standing.filter("source_id IS NOT NULL").groupBy("source_id", "node").agg(F.countDistinct("report").alias("n"), F.count("*").alias("pages_n"))
    kept = kept.filter(F.col("n") >= MIN_PAGES).join(over_all.select("node", "all_n"), "node")
    kept = kept.join(reports.groupBy("source_id").agg(F.countDistinct("report").alias("counted")), "source_id").join(sizes, "source_id")
    share = F.col("n") / F.greatest(F.col("counted"), MIN_SHARE_OF_PAGES * F.col("pages"))
    constant = (share >= CONSTANT_SHARE) | ((F.col("n") >= LOCAL_PAGES) & (share >= LOCAL_SHARE) & (share >= LIFT * F.col("all_n") / F.lit(max(total, 1))))
    place = every.filter("what = 'place'").groupBy("source_id", "node").agg(F.sum("n").alias("place"))
    up = every.filter("what = 'parent'").groupBy("source_id", "node", "title").agg(F.sum("n").alias("n")).groupBy("source_id", "node").agg(F.max_by("title", F.struct("n", "title")).alias("parent"), F.max("n").alias("up_n"))
    slot = every.filter("what = 'slot'").groupBy("source_id", "node").agg((F.sum("n") > F.sum("m")).alias("open"))
    by = ["source_id", "node"]
    kept = kept.filter(constant).join(place, by, "left").join(up, by, "left").join(slot, by, "left")
    kept = kept.select("source_id", "node", (F.col("place") / F.col("pages_n")).alias("place"), F.when(2 * F.col("up_n") > F.col("pages_n"), F.col("parent")).alias("parent"), "open")
    return Templates(materialize(kept, "constants"), send(of_all))


def template_lines(docs: DataFrame) -> DataFrame:
    """``(id, line_no)`` of every non-blank line that belongs to the page and not to its report.

    ``docs``: ``id, source_id, title, body``; further columns are ignored. Null and empty bodies give no
    row; rows without a source are judged by the constants of the corpus alone; an empty table gives an
    empty result; repeated rows are labelled each.
    """
    templates = induce(docs)
    return templates.pages(_slim(docs)).mapInArrow(_label(templates), "id string, line_no bigint")


def main_text(docs: DataFrame, to: str = "body") -> DataFrame:
    """``docs`` with the report alone in column ``to``: the lines that are not template, in their order, blank lines kept out."""
    templates = induce(docs)

    @F.pandas_udf(StringType())
    def report(sources, buckets, titles, bodies):
        def one(source, bucket, title, body):
            if not body:
                return body
            nodes = page_nodes(body)
            return "\n".join(n.text for n, t in zip(nodes, label_page(templates.wrapper(source, bucket), title, nodes, templates.model.value)) if not t)

        rows = list(zip(sources, buckets, titles, bodies))
        out = [None] * len(rows)
        for i in sorted(range(len(rows)), key=lambda i: rows[i][1]):  # bucket by bucket
            out[i] = one(*rows[i])
        return bodies.__class__(out, index=bodies.index, dtype=object)

    return templates.pages(docs).withColumn(to, report("source_id", "__bucket", "title", "body")).drop("__bucket")
