"""Overlap across splits and near-duplicates, against all pairs."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tailrace.llm import bagminhash, split_overlap
from tailrace.llm.near_duplicates import NearDuplicates
from tailrace.llm.split_overlap import SplitOverlap, overlap_report

from . import helpers as h

EXAMPLE = "example_id bigint, text string, split string, source string"
DOC = "id string, source_id string, title string, body string"


def records():
    r = h.rng()
    base = [h.report(r) for _ in range(40)]
    rows = [(i, t, "train", "gold") for i, t in enumerate(base)]
    k = 100
    for i, t in enumerate(base[:15]):
        rows.append((k + i, h.edited(r, t, i % 5), ("val", "test")[i % 2], "silver"))
    rows += [(200, base[3].upper() + "!!", "test", None), (201, base[3], "train", "gold"), (202, None, "val", "gold"), (203, "  ", "val", "gold"), (204, "too short text", "val", "gold"), (205, "too short text", "train", "gold"), (206, h.report(r), "val", "silver"), (207, base[5], None, "gold")]
    return rows


def brute(rows, least):
    out = set()
    for (i, t, s, _), (j, u, v, _) in itertools.combinations(rows, 2):
        if t and u and s and v and (s == "train") != (v == "train") and h.likeness(t, u) >= least:
            out.add((min(i, j), max(i, j)))
    return out


def test_overlap_pairs(spark):
    rows = records()
    got = SplitOverlap(spark.createDataFrame(rows + rows[:2], EXAMPLE), 0.7).pairs().collect()
    assert {tuple(r) for r in got} == brute(rows, 0.7) and len(got) == len({tuple(r) for r in got})


def test_overlap_report_and_records(spark):
    df = spark.createDataFrame(records(), EXAMPLE).withColumnRenamed("source", "source")
    rep = {(r["split"], r["source"]): (r["n_records"], r["n_overlapping"]) for r in overlap_report(df, 0.7).collect()}
    hit = {j for i, j in brute(records(), 0.7)} & {r[0] for r in records() if r[2] in ("val", "test")}
    assert sum(n for _, n in rep.values()) == len(hit) and rep["test", None] == (1, 1)
    got = {r["example_id"]: r for r in SplitOverlap(df, 0.7).records().collect()}
    assert set(got) == hit and got[200]["overlap"] == 1.0


def test_overlap_empty_and_odd_tables(spark):
    none = spark.createDataFrame([], EXAMPLE)
    assert SplitOverlap(none).pairs().isEmpty() and overlap_report(none).isEmpty()
    long = "w1 " * 30 + " ".join(f"x{i}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "train", "a", 1, "z"), (2, long + " end", "test", "a", 1, "z")], EXAMPLE + ", digest int, chunk string")
    assert [tuple(r) for r in SplitOverlap(df, 0.7).pairs().collect()] == [(1, 2)]


def test_hot_copies(spark):
    r = h.rng(1)
    hot, other = h.report(r), h.report(r)
    rows = [(i, hot, "train", "a") for i in range(200)] + [(1000, hot, "test", "a"), (1001, other, "test", "a")] + [(2000 + i, h.report(r), "train", "a") for i in range(300)]
    got = SplitOverlap(spark.createDataFrame(rows, EXAMPLE), 0.7)
    assert got.pairs().count() == 200 and [x["example_id"] for x in got.records().collect()] == [1000]


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcdef ghij", max_size=600), st.integers(0, 600), st.text(alphabet="xyz", min_size=1, max_size=9))
def test_cuts_move_with_the_text(t, at, insert):
    a = t.encode()
    assert split_overlap.cuts(a)[-1] == len(a)
    b = a[:at] + insert.encode() + a[at:]
    tail = {e - len(a) for e in split_overlap.cuts(a) if e > at + split_overlap.WINDOW}
    assert tail <= {e - len(b) for e in split_overlap.cuts(b)}


def near_limit(r, n, least=0.7):
    """Two texts of about ``n`` words, edited word by word as far as their likeness stays at ``least`` or more."""
    a = [r.choice(h.NOUNS) + r.choice(h.NOUNS) for _ in range(n)]
    b = a
    for _ in range(60):
        c, i = list(b), r.choice((0, len(b) - 1, r.randrange(len(b))))
        what = r.randrange(4)
        if what == 0:
            c[i] = r.choice(h.NOUNS) + "x"
        elif what == 1:
            c.insert(i, r.choice(h.NOUNS) + "y")
        elif what == 2:
            del c[i]
        else:
            c = c[i:] + c[:i]
        if h.likeness(" ".join(a), " ".join(c)) >= least:
            b = c
    return " ".join(a), " ".join(b)


def test_overlap_by_length(spark):
    r = h.rng(11)
    rows, want = [], {}
    for n in (6, 8, 10, 12, 16, 20, 30, 50, 70, 100, 130, 160, 185, 220):
        for _ in range(25):
            a, b = near_limit(r, n)
            i = 2 * len(want)
            want[i, i + 1] = n
            rows += [(i, a, "train", "s"), (i + 1, b, "test", "s")]
    got = {tuple(x) for x in SplitOverlap(spark.createDataFrame(rows, EXAMPLE), 0.7).pairs().collect()}
    assert {n for p, n in want.items() if p not in got} == set() and got <= brute(rows, 0.7)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a b c d e f g".split()), min_size=5, max_size=40), st.lists(st.sampled_from("a b c d e f g".split()), min_size=5, max_size=40))
def test_short_records_overlap_as_far_as_they_are_alike(a, b):
    assert split_overlap.overlap_of(a, b, 0.7) >= h.likeness(" ".join(a), " ".join(b)) - 1e-9


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_bagminhash_is_unbiased(share):
    g = np.random.default_rng(4)
    base = g.integers(0, 2**63, 300).astype(np.uint64)
    k = int(300 * 2 * share / (1 + share))
    other = np.concatenate([base[:k], g.integers(0, 2**63, 300 - k).astype(np.uint64)])
    regs, floor = bagminhash.signatures(np.repeat([0, 1], 300), np.concatenate([base, other]), np.ones(600), 2, 4096)
    assert (regs[0] == regs[1]).mean() == pytest.approx(k / (600 - k), abs=0.04) and (regs == floor).all()


def test_bagminhash_weights():
    """Every two counts up to 32 agree in as many registers as the lesser is of the greater; the support's signature doesn't depend on counts."""
    keys = np.random.default_rng(5).integers(0, 2**63, 64).astype(np.uint64)
    both = {c: bagminhash.signatures(np.zeros(64, dtype=np.int64), keys, np.full(64, c), 1, 8192) for c in range(1, 33)}
    for x, y in itertools.combinations(both, 2):
        assert (both[x][0] == both[y][0]).mean() == pytest.approx(x / y, abs=0.03) and (both[x][1] == both[y][1]).all()
    assert bagminhash.bag_bands([np.zeros(0, dtype=np.uint64), keys], 8, 4)[0] is None


def test_repeated_passages(spark):
    """A passage told several times finds the texts that tell it as often, nearly as often, and once."""
    r = h.rng(12)
    rows, want, equal = [], set(), set()
    for times in (1, 2, 4, 8, 15, 64):
        for j in range(8):
            base, once = h.report(r, 6), h.report(r, 6)
            a, b = f"{times:02}-{j}-a", f"{times:02}-{j}-b"
            rows += [(a, "s", None, once + " " + " ".join([base] * times)), (b, "s", None, once + " " + base)]
            want.add((a, b))
            c, d = f"{times:02}-{j}-c", f"{times:02}-{j}-d"
            other = h.report(r, 3)
            rows += [(c, "s", None, " ".join([other] * 15)), (d, "s", None, " ".join([other] * 16))]
            equal.add((c, d))
    near = NearDuplicates(spark.createDataFrame(rows, DOC), 0.7, pages=False)
    got = {tuple(x) for x in near.pairs().collect()}
    brute_pairs = {tuple(sorted((x[0], y[0]))) for x, y in itertools.combinations(rows, 2) if h.likeness(x[3], y[3]) >= 0.7}
    assert got == brute_pairs and equal <= got and want <= got
    bags = {tuple(x) for x in near.pairs("overlap").collect()}
    assert equal <= bags and not {p for p in want if p[0][:2] in ("08", "15", "64")} & bags


def test_groups_of_a_hot_text(spark):
    """Bands whose members fall into several groups are compared in full: groups are the components of all links."""
    r = h.rng(13)
    base = h.report(r, 30)
    rows = [(f"h{i:03}", "s", None, h.edited(r, base, i % 9)) for i in range(60)] + [(f"o{i:02}", "s", None, h.report(r)) for i in range(20)]
    near = NearDuplicates(spark.createDataFrame(rows, DOC), 0.7, pages=False)
    group = {x["id"]: x["group_id"] for x in near.groups().collect()}
    root = {x[0]: x[0] for x in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near.pairs().collect():
        root[find(a)] = find(b)
    sets: dict = {}
    for x in root:
        sets.setdefault(find(x), set()).add(x)
    found: dict = {}
    for x, g in group.items():
        found.setdefault(g, set()).add(x)
    assert sorted(map(sorted, found.values())) == sorted(sorted(v) for v in sets.values() if len(v) > 1)


def pages():
    r = h.rng(3)
    base = [h.report(r) for _ in range(30)]
    rows = [(f"d{i:03}", "s", None, t) for i, t in enumerate(base)]
    rows += [(f"e{i:03}", "s", None, h.edited(r, t, i % 4)) for i, t in enumerate(base[:12])]
    rows += [("z1", "s", None, None), ("z2", None, None, ""), ("z3", "s", None, "four words are few."), ("z4", "s", None, base[2].upper())]
    return rows


def test_near_pairs(spark):
    rows = pages()
    want = {tuple(sorted((a[0], b[0]))) for a, b in itertools.combinations(rows, 2) if a[3] and b[3] and h.likeness(a[3], b[3]) >= 0.7}
    near = NearDuplicates(spark.createDataFrame(rows + rows[:1], DOC), 0.7, pages=False)
    got = near.pairs().collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    groups = {r["id"]: r for r in near.groups().collect()}
    assert set(groups) == {x for p in want for x in p} and groups["z4"]["class_id"] == groups["d002"]["class_id"] and groups["z4"]["copies"] >= 2


def test_near_with_stored_bands(spark):
    rows = pages()
    stored = spark.createDataFrame([("d000", 128, 4, ["b0:a", None]), ("d001", 128, 4, ["b0:a"]), ("d002", 64, 4, ["b0:a"]), ("e001", 128, 4, None), (None, 128, 4, ["b0:a"]), ("gone", 128, 4, ["b0:a"])], "document_id string, num_perm smallint, band_size smallint, band_hashes array<string>")
    df = spark.createDataFrame(rows, DOC)
    a = {tuple(r) for r in NearDuplicates(df, 0.7, stored, pages=False).pairs().collect()}
    assert a == {tuple(r) for r in NearDuplicates(df, 0.7, pages=False).pairs().collect()}


def test_near_empty_and_clashing(spark):
    assert NearDuplicates(spark.createDataFrame([], DOC), 0.7).pairs().isEmpty()
    rows = [(*r, "x", [1]) for r in pages()[:3]]
    df = spark.createDataFrame(rows, DOC + ", digest string, bands array<int>")
    assert NearDuplicates(df, 0.7).groups().isEmpty()


def test_rows_without_an_id(spark):
    t = h.report(h.rng(8))
    recs = spark.createDataFrame([(None, t, "train", "a"), (1, t, "test", "a"), (None, t, "test", "a")], EXAMPLE)
    assert SplitOverlap(recs, 0.7).pairs().isEmpty()
    docs = spark.createDataFrame([(None, "s", None, t), ("a", "s", None, t), (None, "s", None, t)], DOC)
    near = NearDuplicates(docs, 0.7, pages=False)
    assert near.pairs().isEmpty() and near.groups().isEmpty()
