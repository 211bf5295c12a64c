"""Repeated lines and page templates."""

from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tailrace.llm import repeated_lines as rl
from tailrace.llm import wrapper
from tailrace.llm.lines import B, C, H, L, P, T, fold, fold_lines, kind_of

from . import helpers as h

DOC = "id string, source_id string, title string, body string"


def plain_fold(line):
    return "".join(c for c in line.lower() if c.isalpha())


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=80))
def test_fold(t):
    assert fold_lines(t) == [plain_fold(x).encode() for x in t.split("\n")]
    assert fold(t.replace("\n", " ")) == plain_fold(t.replace("\n", " ")).encode()


def corpus():
    r = h.rng(2)
    rows = []
    for i in range(60):
        source = "big" if i % 3 else "small"
        lines = [h.sentence(r) for _ in range(6)]
        if source == "big":
            lines.insert(r.randrange(7), ("Share this  page!", "SHARE THIS PAGE", "share-this page 7")[i % 3])
            if i % 5 == 0:
                lines.insert(2, "seen in few")
            lines = ["# Title here", *lines, "--- 12 ---", ""]
        elif i < 9:
            lines.append("only three of small")
        rows.append((f"d{i}", source, "T", ("\r\n" if i % 2 else "\n").join(lines)))
    return rows + [("n1", "big", None, None), ("n2", "big", None, ""), ("n3", None, None, "Share this page\nShare this page")] + [(f"t{i}", "tiny", None, "same line\nsame line") for i in range(3)] + [(f"u{i}", "four", None, "x y\nsame") for i in range(4)]


def brute(rows, share=0.2, least=4):
    docs, at = Counter(), defaultdict(set)
    for id_, s, _, body in rows:
        if s is None:
            continue
        docs[s] += 1
        for line in (body or "").split("\n"):
            if plain_fold(line) and line.lstrip()[:1] != "#":
                at[s, plain_fold(line)].add(id_)
    out = set()
    for id_, s, _, body in rows:
        for no, line in enumerate((body or "").split("\n"), 1):
            k = (s, plain_fold(line))
            if k[1] and line.lstrip()[:1] != "#" and len(at.get(k, ())) >= max(least, share * docs[s]):
                out.add((id_, no))
    return out


def test_repeated_lines(spark):
    rows = corpus()
    got = rl.repeated_line_rows(spark.createDataFrame(rows, DOC).repartition(5)).collect()
    assert {tuple(r) for r in got} == brute(rows) and len(got) == len(brute(rows))


def test_repeated_lines_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(rl, "MAX_BROADCAST_LINES", 0)
    rows = corpus()
    df = spark.createDataFrame(rows, DOC)
    assert {tuple(r) for r in rl.repeated_line_rows(df).collect()} == brute(rows)
    cut = {r["id"]: r["body"] for r in rl.strip_repeated_lines(df).collect()}
    monkeypatch.undo()
    assert cut == {r["id"]: r["body"] for r in rl.strip_repeated_lines(df).collect()}


def test_broadcast_and_join_agree_on_odd_rows(spark, monkeypatch):
    """Repeated ids, rows without an id and two bodies under one id: both branches count rows and cut the same lines."""
    rows = [("a", "s", None, f"own {'abcdefgh'[i]}\nstanding line") for i in range(3)]
    rows += [("b", "s", None, "standing line\nother one"), ("b", "s", None, "first of two\nsecond\nSTANDING line 7\nstanding line")]
    rows += [(None, "s", None, "nobody's\nrare line"), (None, "s", None, "rare line\nsomebody's"), ("c", "s", None, "rare line"), ("c", "s", None, "rare line")]
    df = spark.createDataFrame(rows, DOC).repartition(3)

    def both():
        return sorted(map(tuple, rl.repeated_line_rows(df).collect()), key=str), sorted((tuple(r) for r in rl.strip_repeated_lines(df).collect()), key=str)

    sent = both()
    monkeypatch.setattr(rl, "MAX_BROADCAST_LINES", 0)
    assert both() == sent
    assert ("b", 3) in sent[0] and ("b", 4) in sent[0] and (None, 2) in sent[0] and sent[0].count(("c", 1)) == 2
    assert ("b", "s", None, "first of two\nsecond") in sent[1]


def test_strip_keeps_rows_and_columns(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], DOC + ", line int, docs string")
    got = rl.strip_repeated_lines(df).collect()
    gone = brute(rows)
    want = {i: None if b is None else "\n".join(x for no, x in enumerate(b.split("\n"), 1) if (i, no) not in gone) for i, _, _, b in rows}
    assert {r["id"]: r["body"] for r in got} == want and got[0].asDict().keys() == set(df.columns) and len(got) == len(rows)


def test_empty(spark):
    none = spark.createDataFrame([], DOC)
    assert rl.repeated_line_rows(none).isEmpty() and wrapper.template_lines(none).isEmpty() and rl.strip_repeated_lines(none).isEmpty()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), max_size=8), min_size=1, max_size=60), st.sampled_from([0.1, 0.3, 0.6]))
def test_summaries_miss_nothing(docs, share):
    true = Counter(k for d in docs for k in d)
    parts = [docs[0::2], docs[1::2]]
    total, lost = Counter(), 0
    for part in parts:
        s = rl.Summary()
        for d in part:
            s.add(d)
            s.shrink(share)
        s.spend(share)
        lost += s.lost
        total.update(s.counts)
        assert s.lost <= share / 2 * len(part)
    for k, n in true.items():
        if n >= share * len(docs):
            assert total[k] > 0 and total[k] + lost >= n


@pytest.mark.parametrize(
    ("line", "kind"),
    [("## Cause", H), ("#tag, other", B), ("- do this", L), ("1. do this", L), ("07:12 - it began", T), ("    ctl drain --all", C), ("It broke at once.", P), ("Home | Docs | Blog", B), ("Home » Archive » 2022 » It broke.", B), ("Read next", B)],
)
def test_kinds(line, kind):
    assert kind_of(line, line.strip()) == kind


def forest(shape):
    return [wrapper.Part(k, forest(c)) for k, c in shape]


SHAPE = st.recursive(st.just([]), lambda c: st.lists(st.tuples(st.integers(0, 3), c), max_size=4), max_leaves=12)


def largest(a, b):
    """The size of the largest matching that keeps order and descent, by the recurrence over last trees."""
    if not a or not b:
        return 0
    (k, below), (q, under) = a[-1], b[-1]
    both = largest(a[:-1], b[:-1]) + 1 + largest(below, under) if k == q else 0
    return max(both, largest(a[:-1], b), largest(a, b[:-1]))


@settings(max_examples=80, deadline=None)
@given(SHAPE, SHAPE)
def test_tree_match(a, b):
    x, y = forest(a), forest(b)
    n, pairs = wrapper.tree_match(x, y)
    assert n == len(pairs) == largest(a, b) and all(p.key == q.key for p, q in pairs)
    assert len({id(p) for p, _ in pairs}) == len({id(q) for _, q in pairs}) == n


def test_page_trees():
    nodes = wrapper.page_nodes("- a first item\nRead next\n- one\n- two\n\nText that stands here ends.\n- three")
    assert [len(n.children) for n in nodes] == [0, 2, 0, 0, 1, 0] and [n.no for n in wrapper.roots_of(nodes)] == [1, 2, 6]


def site_pages(r, n, source, copies=0):
    """Pages of one site, and the numbers of the lines that aren't the report's."""
    rows, truth = [], set()
    hot = [h.sentence(r) for _ in range(9)]
    for i in range(n):
        title = f"Why {r.choice(h.NOUNS)} {r.choice(h.VERBS)}"
        body = [("own", title), ("own", "## What happened"), *[("own", h.sentence(r)) for _ in range(4)], ("own", "## To do"), *[("own", f"- check {r.choice(h.NOUNS)} {r.randrange(99)}") for _ in range(2)]]
        if i < copies:
            body = [("own", x) for x in hot]
        page = [("page", f"{source} - home | docs | about"), *body, ("page", f"All times on {source} are local."), ("page", "Read next"), ("page", f"- Why {r.choice(h.NOUNS)} {r.choice(h.VERBS)}"), ("page", f"{r.randrange(90)} comments on this")]
        if r.random() < 0.5:
            page.insert(r.randrange(1, len(page)), ("page", f"Try {r.choice(h.NOUNS)} for {r.randrange(90)} days"))
        id_ = f"{source}{i}"
        rows.append((id_, source, title if i % 4 else None, "\n".join(x for _, x in page)))
        truth |= {(id_, no) for no, (what, _) in enumerate(page, 1) if what == "page"}
    return rows, truth


def test_template_lines(spark):
    r = h.rng(11)
    rows, truth = [], set()
    for source in ("siteone", "sitetwo", "sitethree"):
        more, lines = site_pages(r, 40, source)
        rows += more
        truth |= lines
    rows += [("x1", "siteone", None, None), ("x2", None, None, "")]
    got = {tuple(x) for x in wrapper.template_lines(spark.createDataFrame(rows, DOC).repartition(3)).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 0.02 * len(truth)
    text = {x["id"]: x["report"] for x in wrapper.main_text(spark.createDataFrame(rows, DOC), "report").collect()}
    assert "comments on this" not in text["siteone1"] and "## What happened" in text["siteone1"] and text["x1"] is None and text["x2"] == ""


def test_buckets_of_sources(spark, monkeypatch):
    r = h.rng(13)
    rows = [x for source in ("siteone", "sitetwo", "sitethree") for x in site_pages(r, 30, source)[0]] + [("x", None, None, "Home\nIt broke after lunch on a day.")]
    df = spark.createDataFrame(rows, DOC)
    whole = sorted(map(tuple, wrapper.template_lines(df).collect()))
    monkeypatch.setattr(wrapper, "BUCKET_ROWS", 4)
    assert wrapper.induce(df).buckets > 2
    assert sorted(map(tuple, wrapper.template_lines(df).collect())) == whole
    assert wrapper.main_text(df).count() == len(rows)


def test_the_wrapper_decides(spark):
    """Without a wrapper nearly all template lines are content; aligned nodes keep their place in it."""
    rows, truth = site_pages(h.rng(17), 60, "siteone")
    templates = wrapper.induce(spark.createDataFrame(rows, DOC))
    site = templates.wrapper("siteone", 0)
    assert site.parts and site.keys and site.open
    found, bare = set(), set()
    for id_, _, title, body in rows:
        nodes = wrapper.page_nodes(body)
        for out, with_ in ((found, site), (bare, wrapper.NO_WRAPPER)):
            out |= {(id_, n.no) for n, t in zip(nodes, wrapper.label_page(with_, title, nodes, templates.model.value)) if t}
    assert len(found & truth) >= 0.97 * len(truth) and len(bare) <= 0.1 * len(truth)


def test_related_heading_is_template(spark):
    """A heading that only titles of other pages hang from belongs to the page; one that the report's items hang from doesn't."""
    r = h.rng(18)
    rows, truth = site_pages(r, 60, "siteone")
    more, wanted = [], set()
    for id_, source, title, body in rows:
        n = body.count("\n") + 1
        more.append((id_, source, title, body + f"\n## Related\n- Why {r.choice(h.NOUNS)} {r.choice(h.VERBS)}\n- Why {r.choice(h.NOUNS)} {r.choice(h.VERBS)}"))
        wanted |= {(id_, n + i) for i in (1, 2, 3)}
    got = {tuple(x) for x in wrapper.template_lines(spark.createDataFrame(more, DOC)).collect()}
    assert len(got & wanted) >= 0.97 * len(wanted) and len(got - truth - wanted) <= 0.02 * len(truth)


def test_copies_are_no_template(spark):
    r = h.rng(12)
    rows, truth = site_pages(r, 60, "siteone", copies=20)
    more, lines = site_pages(r, 40, "sitetwo")
    got = {tuple(x) for x in wrapper.template_lines(spark.createDataFrame(rows + more, DOC)).collect()}
    assert len(got - truth - lines) <= 0.03 * len(truth | lines)


def standing_pages(r, n, source, title, copies=0):
    """Pages with three standing notices in prose, and these lines."""
    rows, truth = [], set()
    notices = [h.sentence(r) for _ in range(3)]
    hot = [h.sentence(r) for _ in range(9)]
    for i in range(n):
        body = hot if i < copies else [h.sentence(r) for _ in range(9)]
        rows.append((f"{source}{i}", source, title(i), "\n".join([notices[0], "## What happened", *body, *notices[1:]])))
        truth |= {(f"{source}{i}", no) for no in (1, 12, 13)}
    return rows, truth


@pytest.mark.parametrize("title", [lambda i: "Status of our site", lambda i: f"Incident {4711 + i}", lambda i: "Only one is titled" if i == 7 else None, lambda i: ("Outages", "Maintenance")[i % 2]])
def test_alike_titles_are_no_copies(spark, title):
    rows, truth = standing_pages(h.rng(14), 40, "siteone", title)
    assert {tuple(x) for x in wrapper.template_lines(spark.createDataFrame(rows, DOC)).collect()} == truth


@pytest.mark.parametrize("title", [lambda i: "Status of our site", lambda i: f"Why it broke {i if i > 15 else ''}", lambda i: None])
def test_copies_among_alike_titles(spark, title):
    rows, truth = standing_pages(h.rng(15), 50, "siteone", title, copies=15)
    assert {tuple(x) for x in wrapper.template_lines(spark.createDataFrame(rows, DOC)).collect()} == truth


def cluttered_pages(r, n, source, copies=0, edits=0):
    """Pages of six standing notices and five sentences of report, and the notices' lines; ``copies`` tell one report, with ``edits`` of its sentences changed."""
    rows, truth = [], set()
    notices = [h.sentence(r) for _ in range(6)]
    hot = [h.sentence(r) for _ in range(5)]
    for i in range(n):
        body = [h.sentence(r) for _ in range(5)]
        if i < copies:
            body = body[:edits] + hot[edits:]
        rows.append((f"{source}{i}", source, f"Why {r.choice(h.NOUNS)} {r.choice(h.VERBS)} {r.choice(h.NOUNS)}", "\n".join([*notices[:3], *body, *notices[3:]])))
        truth |= {(f"{source}{i}", no) for no in (1, 2, 3, 9, 10, 11)}
    return rows, truth


@pytest.mark.parametrize(("copies", "edits"), [(0, 0), (12, 0), (12, 1)])
def test_cluttered_pages_are_no_copies(spark, copies, edits):
    rows, truth = cluttered_pages(h.rng(16), 60, "siteone", copies, edits)
    assert {tuple(x) for x in wrapper.template_lines(spark.createDataFrame(rows, DOC)).collect()} == truth
