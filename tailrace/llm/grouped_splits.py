"""Train, validation and test splits that keep related records together.

Entities (the orgs and incidents that records name) are the nodes of a graph, records its edges. A persisted
component table (``save_components``, ``load_components``) says of every entity which component it is in and which
split that has. Entities of new records are looked up there first, so only edges between components (a new entity is
one of its own) are left to contract: every component hooks to its smallest neighbour, pointer jumping flattens the
chains, the edges are relabelled, and so on until none is left. What is contracted thus grows with the new records and
not with the table. Orgs sort before incidents, so that after one round only edges between orgs remain.

A component that already has a split keeps it, and gives it to what joins it. Where a merge brings
components of different splits together the whole is quarantined. New components fill what each split
lacks: those of over ``LARGE`` of all records (at most 1 / LARGE of them) one by one into the largest
deficit, the rest by a hash of their name in proportion to the deficits that are left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tailrace.session import materialize

#: Components above this share of all records are placed one by one; there are at most 1 / LARGE of them.
LARGE = 0.001
UNKNOWN = ("", "unknown")
QUARANTINE = "quarantine"

COMPONENTS = "entity string, component string, split string, size bigint"


def named(value: Column) -> Column:
    """A trimmed, lower-cased name; null for null, blank and ``unknown``."""
    clean = F.regexp_replace(F.lower(value.cast("string")), "^[\\s\\u00a0]+|[\\s\\u00a0]+$", "")
    return F.when(~clean.isin(*UNKNOWN), clean)


def entity_columns(columns: Sequence[str]) -> list[Column]:
    """One node name per entity column, null where the record names none; earlier columns sort first."""
    return [F.concat(F.lit(f"{i}:"), named(F.col(c))) for i, c in enumerate(columns)]


def components_of(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges (u, v)`` that isn't its own root. A root is the smallest node it reaches.

    Every round at least halves the components that still have edges; ``max_rounds`` that leave some are an error.
    """
    edges = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct(), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        if len(steps) == max_rounds:
            raise RuntimeError(f"components still have edges after {max_rounds} rounds")
        # every node but a local minimum hooks to its smallest neighbour
        hook = materialize(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root")), "hook")
        while True:  # pointer jumping
            up = hook.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            jumped = materialize(hook.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root"), F.col("higher").isNotNull().alias("moved")), "jump")
            if jumped.filter("moved").isEmpty():
                break
            hook = jumped.select("node", "root")
        steps.append(hook)
        to = hook.select(F.col("node").alias("u"), F.col("root").alias("ru"))
        tv = hook.select(F.col("node").alias("v"), F.col("root").alias("rv"))
        moved = edges.join(tv, "v").join(to, "u", "left").select(F.coalesce("ru", "u").alias("x"), F.col("rv").alias("y"))
        edges = materialize(moved.filter("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    known = steps[0]
    for step in steps[1:]:  # roots of an earlier round may have hooked in a later one
        later = step.select(F.col("node").alias("root"), F.col("root").alias("higher"))
        known = known.join(later, "root", "left").select("node", F.coalesce("higher", "root").alias("root")).unionByName(step)
    return materialize(known.dropDuplicates(["node"]), "roots")


def save_components(table: DataFrame, folder: str) -> None:
    """Write a component table as the next version in ``folder``. A version counts once it is whole, so that a writer lost midway leaves the one before."""
    versions = _versions(table.sparkSession, folder)
    table.select("entity", "component", "split", "size").write.parquet(f"{folder}/version={max(versions, default=0) + 1:09d}")


def load_components(spark: SparkSession, folder: str) -> DataFrame | None:
    """The latest whole version in ``folder``, or None where there is none."""
    versions = _versions(spark, folder)
    return spark.read.schema(COMPONENTS).parquet(f"{folder}/version={max(versions):09d}") if versions else None


def _versions(spark: SparkSession, folder: str) -> list[int]:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(path):
        return []
    names = [f.getPath() for f in files.listStatus(path) if f.getPath().getName().startswith("version=")]
    return [int(p.getName().split("=")[1]) for p in names if files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]


def update_components(records: DataFrame, key: str, columns: Sequence[str], targets: dict[str, float], existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the new component table ``entity, component, split, size``, the records' ``key, component, split``).

    ``existing``: an earlier component table. Records without any entity are components of their own; repeated
    rows count as often as they stand; null keys stay. Further columns are ignored. Split is ``quarantine`` where merged
    components had different ones.
    """
    if not targets:
        raise ValueError("no split targets")
    if existing is None:
        existing = records.sparkSession.createDataFrame([], COMPONENTS)
    nodes = F.array_compact(F.array(*entity_columns(columns)))
    named_records = records.select(F.col(key).alias("_key"), nodes.alias("n")).select("_key", "n", F.coalesce(F.get("n", F.lit(0)), F.concat(F.lit("~:"), F.coalesce(F.col("_key").cast("string"), F.lit("")))).alias("first"))
    # the entities of these records, each with the component it is in so far
    mine = named_records.select(F.explode(F.when(F.size("n") > 0, F.col("n")).otherwise(F.array("first"))).alias("entity")).distinct()
    was = materialize(mine.join(existing.select("entity", F.col("component").alias("known")), "entity", "left").select("entity", F.coalesce("known", "entity").alias("was"), F.col("known").isNull().alias("fresh")), "entities")
    # a star for each record, from the first entity it names to each other one; then between their components
    star = named_records.filter("size(n) > 1").select(F.col("first").alias("u"), F.explode(F.slice("n", 2, len(columns))).alias("v")).distinct()
    at = was.select("entity", "was")
    edges = star.join(at.withColumnsRenamed({"entity": "u", "was": "x"}), "u").join(at.withColumnsRenamed({"entity": "v", "was": "y"}), "v").filter("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v"))
    roots = components_of(edges)
    now = was.join(roots, F.col("was") == F.col("node"), "left").select("entity", F.coalesce("root", "was").alias("component"), "fresh")
    placed = materialize(named_records.join(now.select(F.col("entity").alias("first"), "component"), "first").select("_key", "component"), "placed")
    # the old components, under the names they have now, with what they held
    old = existing.groupBy(F.col("component").alias("known")).agg(F.first("split").alias("split"), F.first("size").alias("held"))
    old = old.join(roots, F.col("known") == F.col("node"), "left").select(F.coalesce("root", "known").alias("component"), "split", "held")
    old = old.groupBy("component").agg(F.min("split").alias("low"), F.max("split").alias("high"), F.sum("held").alias("held"))
    old = old.select("component", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(QUARANTINE)).alias("split"), "held")
    sizes = placed.groupBy("component").agg(F.count("*").alias("n")).join(old, "component", "full")
    sizes = materialize(sizes.select("component", (F.coalesce("n", F.lit(0)) + F.coalesce("held", F.lit(0))).cast("long").alias("size"), "split"), "sizes")
    chosen = materialize(fill_deficits(sizes, targets), "chosen")
    kept = existing.select("entity", "component").join(roots, F.col("component") == F.col("node"), "left").select("entity", F.coalesce("root", "component").alias("component"))
    table = kept.unionByName(now.filter("fresh").select("entity", "component")).join(chosen, "component").select("entity", "component", "split", "size")
    return table, placed.join(chosen.select("component", "split"), "component").select(F.col("_key").alias(key), "component", "split")


def fill_deficits(sizes: DataFrame, targets: dict[str, float]) -> DataFrame:
    """``component, size, split`` with every null split filled."""
    spark = sizes.sparkSession
    have = {r["split"]: r["n"] for r in sizes.groupBy("split").agg(F.sum("size").alias("n")).collect()}
    total = sum(n or 0 for n in have.values())
    whole = sum(targets.values())
    lack = {s: t / whole * total - (have.get(s) or 0) for s, t in sorted(targets.items())}
    fresh = sizes.filter("split IS NULL")
    large = fresh.filter(F.col("size") > LARGE * total).orderBy(F.desc("size"), "component").collect()  # at most 1 / LARGE rows
    placed = []
    for r in large:
        to = max(lack, key=lambda s: (lack[s], s))
        lack[to] -= r["size"]
        placed.append((r["component"], to))
    open_ = {s: max(0.0, n) for s, n in lack.items()}
    room = sum(open_.values()) or 1.0
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(7), "component"), 11).cast("double")) / float(1 << 53)
    choice: Column | None = None
    edge = 0.0
    names = [s for s in open_ if open_[s] > 0] or [max(targets, key=lambda s: targets[s])]
    for s in names[:-1]:
        edge += open_[s] / room
        choice = F.when(u < edge, s) if choice is None else choice.when(u < edge, s)
    by_hash = F.lit(names[-1]) if choice is None else choice.otherwise(names[-1])
    by_hand = spark.createDataFrame(placed, "component string, _to string")
    return sizes.join(F.broadcast(by_hand), "component", "left").select("component", "size", F.coalesce("split", "_to", by_hash).alias("split"))


def component_names(table: DataFrame, position: int = 0) -> DataFrame:
    """One row for each name of entity column ``position``: ``name``, ``first_name`` (the smallest of its component), ``n_names`` of the component, its ``split`` and ``size``."""
    mine = table.filter(F.col("entity").startswith(f"{position}:")).select("component", F.expr(f"substring(entity, {len(str(position)) + 2})").alias("name"), "split", "size")
    whole = mine.groupBy("component").agg(F.min("name").alias("first_name"), F.count("*").alias("n_names"))
    return mine.join(whole, "component").select("name", "first_name", "n_names", "split", "size")


def tied_names(table: DataFrame, position: int = 0) -> DataFrame:
    """``(a, b)``, a < b: every two names of entity column ``position`` that one component holds. ``component_names`` has a row for each name instead."""
    mine = table.filter(F.col("entity").startswith(f"{position}:")).select("component", F.expr(f"substring(entity, {len(str(position)) + 2})").alias("name"))
    several = mine.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    kept = mine.join(several, "component", "left_semi")
    return kept.select("component", F.col("name").alias("a")).join(kept.select("component", F.col("name").alias("b")), "component").filter("a < b").select("a", "b")
