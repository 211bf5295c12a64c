"""Splits that keep related records together, and consensus labels."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tailrace.llm import grouped_splits as gs
from tailrace.llm.consensus import Consensus, digamma

EX = "example_id bigint, org string, incident_id string"
LABEL = "incident_id string, label string, source string, annotator_id string, annotation_round smallint"
TARGETS = {"train": 0.7, "val": 0.15, "test": 0.15}


def graph(n=400, orgs=60, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        org = r.choice([f"org{r.randrange(orgs)}", f" ORG{r.randrange(orgs)} ", None, "unknown", "", "\t"]) if r.random() < 0.6 else "hot"
        rows.append((i, org, r.choice([None, f"i{r.randrange(n)}"])))
    return rows


def union(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for i, org, inc in rows:
        o = (org or "").strip().lower()
        nodes = ([("o", o)] if o and o != "unknown" else []) + ([("i", inc.strip().lower())] if inc else [])
        for a, b in zip(nodes, nodes[1:]):
            parent[find(a)] = find(b)
        for a in nodes:
            find(a)
    return find


def test_components(spark):
    rows = graph()
    find = union(rows)
    table, placed = gs.update_components(spark.createDataFrame(rows, EX), "example_id", ["org", "incident_id"], TARGETS)
    got = {r["example_id"]: (r["component"], r["split"]) for r in placed.collect()}
    assert len(got) == len(rows)
    by_root = defaultdict(set)
    for i, org, inc in rows:
        o = (org or "").strip().lower()
        node = ("o", o) if o and o != "unknown" else ("i", inc) if inc else ("r", i)
        by_root[find(node)].add(got[i])
    assert all(len(v) == 1 for v in by_root.values()) and len({v for s in by_root.values() for v in s}) == len(by_root)
    names = defaultdict(set)
    for i, org, inc in rows:
        o = (org or "").strip().lower()
        if o and o != "unknown":
            names[find(("o", o))].add(o)
    want = {(a, b) for s in names.values() for a in s for b in s if a < b}
    assert {tuple(r) for r in gs.tied_names(table).collect()} == want


def test_chain(spark):
    rows = [(i, f"n{k:03}", f"e{i // 2:03}") for i, k in enumerate(x for j in range(80) for x in (j, j + 1))]
    table, placed = gs.update_components(spark.createDataFrame(rows, EX), "example_id", ["org", "incident_id"], TARGETS)
    assert placed.select("component").distinct().count() == 1 and gs.tied_names(table).count() == 81 * 80 // 2


def test_shares(spark):
    rows = [(i, f"o{i % 700}", None) for i in range(4000)]
    placed = gs.update_components(spark.createDataFrame(rows, EX), "example_id", ["org", "incident_id"], TARGETS)[1]
    n = Counter(r["split"] for r in placed.collect())
    assert all(abs(n[s] / 4000 - t) < 0.03 for s, t in TARGETS.items())


def test_incremental(spark):
    first = [(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, "c", "w")]
    old = spark.createDataFrame([("0:a", "0:a", "train", 5), ("1:x", "0:a", "train", 5), ("0:b", "0:b", "val", 3), ("0:q", "0:q", "test", 2)], "entity string, component string, split string, size bigint")
    new = spark.createDataFrame(first + [(5, "a", "n1"), (6, "d", "n1"), (7, "b", "n2"), (8, "q", "n2")], EX)
    table, placed = gs.update_components(new, "example_id", ["org", "incident_id"], TARGETS, old)
    got = {r["example_id"]: r["split"] for r in placed.collect()}
    assert got[1] == got[5] == got[6] == "train", "what joins an old component takes its split"
    assert got[7] == got[8] == got[2] == gs.QUARANTINE, "a merge of val and test is quarantined"
    assert got[3] == got[4] and got[3] in TARGETS
    kept = {r["entity"]: r["split"] for r in table.collect()}
    assert kept["0:a"] == "train" and kept["0:d"] == "train" and kept["0:q"] == gs.QUARANTINE


def test_batches_give_the_components_of_one(spark, tmp_path):
    """Three batches over a saved table end in the components that one batch finds; only a whole version counts."""
    r = random.Random(3)
    rows = [(i, f"o{r.randrange(40)}" if r.random() < 0.8 else None, f"x{r.randrange(60)}" if r.random() < 0.7 else None) for i in range(150)]
    whole = gs.update_components(spark.createDataFrame(rows, EX), "example_id", ["org", "incident_id"], TARGETS)[0]
    folder = f"file://{tmp_path}/components"
    assert gs.load_components(spark, folder) is None
    for at in range(0, 150, 50):
        table, placed = gs.update_components(spark.createDataFrame(rows[at : at + 50], EX), "example_id", ["org", "incident_id"], TARGETS, gs.load_components(spark, folder))
        assert placed.count() == 50
        gs.save_components(table, folder)
    (tmp_path / "components" / "version=000000009").mkdir()
    table = gs.load_components(spark, folder)

    def sets(t):
        out = defaultdict(set)
        for x in t.collect():
            out[x["component"]].add(x["entity"])
        return {k: frozenset(v) for k, v in out.items()}

    assert sets(table) == sets(whole) and table.count() == whole.count()
    sizes = {(x["component"], x["size"]) for x in table.collect()}
    assert sum(n for _, n in sizes) == 150 and len(sizes) == len(sets(table))
    names = {x["name"]: x for x in gs.component_names(table).collect()}
    pairs = {tuple(x) for x in gs.tied_names(table).collect()}
    assert sum(x["n_names"] - 1 for x in names.values()) == 2 * len(pairs) and all(names[a]["first_name"] == names[b]["first_name"] for a, b in pairs)


def test_too_few_rounds_are_an_error(spark):
    chain = spark.createDataFrame([(f"{i * 7919 % 64:02}", f"{(i + 1) * 7919 % 64:02}") for i in range(63)], "u string, v string")
    with pytest.raises(RuntimeError):
        gs.components_of(chain, max_rounds=1)
    assert {x["root"] for x in gs.components_of(chain).collect()} == {"00"}


def test_splits_empty(spark):
    table, placed = gs.update_components(spark.createDataFrame([], EX), "example_id", ["org", "incident_id"], TARGETS)
    assert table.isEmpty() and placed.isEmpty() and gs.tied_names(table).isEmpty()
    table, placed = gs.update_components(spark.createDataFrame([(None, None, None), (1, None, None), (1, None, None)], EX).withColumn("component", F.lit(1)), "example_id", ["org", "incident_id"], TARGETS)
    assert placed.count() == 3


def test_digamma(spark):
    values = {1.0: -0.5772156649, 0.5: -1.9635100260, 10.0: 2.2517525890, 3.5: 1.1031566406}
    for x, want in values.items():
        got = spark.range(1).select(digamma(F.lit(x)).alias("d")).head()["d"]
        assert got == pytest.approx(want, abs=1e-7)


TAX = ["dns", "bad-deploy", "quota-limit", "human-error"]


def votes(seed=5, items=250):
    """Five good annotators, one that picks at random, one that is wrong on purpose."""
    r = random.Random(seed)
    rows, truth = [], {}
    for i in range(items):
        true = set(r.sample(TAX, r.choice([0, 1, 1, 2])))
        truth[f"i{i}"] = true
        for a in r.sample(range(7), 5):
            said = {x for x in TAX if (x in true) != (r.random() < (0.05 if a < 5 else 0.5 if a == 5 else 0.9))}
            for x in said or {"__reviewed__"}:
                rows.append((f"i{i}", x if r.random() < 0.8 else x.upper().replace("-", "_") + " ", "human", f"Ann-{a} " if r.random() < 0.2 else f"ann-{a}", 1))
    return rows, truth


def test_consensus(spark):
    rows, truth = votes()
    noise = [("i0", "dns", "weak", "w", 1), ("i1", None, "human", "ann-0", 0), (None, "dns", "human", "ann-0", 1), ("i2", "dns", "human", None, 1), ("i3", "no such", "human", "ann-1", 0)]
    c = Consensus(spark.createDataFrame(rows + rows[:50] + noise, LABEL), TAX)
    got = defaultdict(set)
    for r in c.labels().collect():
        got[r["incident_id"]].add(r["label"])
    wrong = sum(got[i] != t for i, t in truth.items())
    assert wrong <= 0.04 * len(truth)
    rel = {r["annotator"]: r for r in c.annotators().collect()}
    assert rel["ann-0"]["sensitivity"] > 0.85 and rel["ann-6"]["sensitivity"] < 0.3 and 0.3 < rel["ann-5"]["sensitivity"] < 0.7 and len(rel) == 7
    assert all(r["sensitivity_low"] <= r["sensitivity"] <= r["sensitivity_high"] for r in rel.values())
    assert {r["label"] for r in c.agreement().collect()} == set(TAX)


def test_consensus_by_joins(spark, monkeypatch):
    from tailrace.llm import consensus

    df = spark.createDataFrame(votes(items=60)[0], LABEL)
    few = {(r["incident_id"], r["label"]): r["posterior"] for r in Consensus(df, TAX, iterations=4).labels().collect()}
    monkeypatch.setattr(consensus, "MAX_ANNOTATORS", 0)
    many = {(r["incident_id"], r["label"]): r["posterior"] for r in Consensus(df, TAX, iterations=4).labels().collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 for k in few)


def test_consensus_stops_by_change(spark):
    df = spark.createDataFrame(votes(items=120)[0], LABEL)
    c, d = Consensus(df, TAX), Consensus(df, TAX, iterations=60, converged=0.0)
    assert c.change <= 1e-3 and c.iterations < 60
    a, b = ({(r["incident_id"], r["label"]): r["posterior"] for r in x.labels().collect()} for x in (c, d))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 0.01 for k in a)
    with pytest.raises(ValueError):
        Consensus(df, [f"l{i}" for i in range(63)])


def test_only_the_last_round_counts(spark):
    rows = [("a", "dns", "human", "x", None), ("a", "bad-deploy", "human", "x", 1), ("a", "quota-limit", "human", "x", 2), ("a", "quota-limit", "human", "y", 1), ("a", "quota-limit", "human", "z", None), ("b", "__reviewed__", "human", "x", 1), ("b", "__reviewed__", "human", "y", 1)]
    c = Consensus(spark.createDataFrame(rows, LABEL), TAX)
    assert [(r["incident_id"], r["label"]) for r in c.labels().collect()] == [("a", "quota-limit")]


def test_consensus_empty(spark):
    c = Consensus(spark.createDataFrame([], LABEL), TAX, iterations=2)
    assert c.labels().isEmpty() and c.annotators().isEmpty() and c.agreement().isEmpty()
