"""Data sets and evaluation: merging gold and silver, splits, weights, thresholds, metrics, calibration, slices, gates.

Predictions are held in long form: ``example_id, label, y, prob``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.functions.text import strip
from tailrace.taxonomy import LABELS, REVIEWED

GOLD_WEIGHT, SILVER_WEIGHT = 1.0, 0.7
POS_WEIGHT_CAP = 10.0
THRESHOLDS = (0.1, 0.9, 81)
MAX_MACRO_DROP, MAX_LABEL_DROP = 0.01, 0.03


def merge_silver_gold(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``id, labels (0/1 by taxonomy), weight``: human labels if there are any, else weak ones; blank texts and rows without a label drop out.

    ``texts``: ``id, text``; ``labels``: ``incident_id, label, source``.
    """
    known = labels.filter(F.col("label").isin(*LABELS) & (F.col("label") != REVIEWED))
    sets = known.groupBy("incident_id").agg(F.collect_set(F.when(F.col("source") == "human", F.col("label"))).alias("gold"), F.collect_set(F.when(F.col("source") == "weak", F.col("label"))).alias("silver"))
    j = texts.filter(strip(F.col("text")) != "").join(sets, F.col("id") == F.col("incident_id"))
    is_gold = F.size("gold") > 0
    chosen = F.when(is_gold, F.col("gold")).otherwise(F.col("silver"))
    hot = F.transform(F.array(*[F.lit(x) for x in LABELS]), lambda x: F.array_contains(chosen, x).cast("int"))
    return j.filter(F.size(chosen) > 0).select("id", hot.alias("labels"), F.when(is_gold, GOLD_WEIGHT).otherwise(SILVER_WEIGHT).alias("weight"))


def rank_within(rows: DataFrame, group: str, order: Column, tie: str, bits: int = 10) -> DataFrame:
    """``rows`` with ``rank`` (from 0) and ``of``, each row's place in its group by a 32-bit hash ``order``.

    No task sorts a whole group: rows are ranked within buckets of the hash, and the counts of the buckets
    before (a table of groups x 2 ** bits rows) are added.
    """
    b = rows.withColumn("_u", order).withColumn("_b", F.shiftright("_u", 32 - bits))
    counts = b.groupBy(group, "_b").agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group).orderBy("_b")
    before = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), (F.sum("_c").over(w) - F.col("_c")).alias("_before"), F.sum("_c").over(Window.partitionBy(group)).alias("of"))
    ranked = b.withColumn("_rn", F.row_number().over(Window.partitionBy(group, "_b").orderBy("_u", tie)))
    return ranked.join(before, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_bb"))).withColumn("rank", F.col("_before") + F.col("_rn") - 1).drop("_u", "_b", "_g", "_bb", "_before", "_rn")


def stratified_split(examples: DataFrame, val: float = 0.15, test: float = 0.15, seed: str = "42") -> DataFrame:
    """``example_id, stratum, split``: examples are grouped by their rarest label; within a group the first by hash are val, the next test, the rest train. Under ten examples are all train."""
    if val + test >= 1.0:
        val, test = 0.15, 0.15
    freq = examples.select(F.posexplode("labels").alias("k", "y")).filter("y = 1").groupBy("k").agg(F.count("*").alias("freq"))
    rare = examples.select("example_id", F.posexplode("labels").alias("k", "y")).filter("y = 1").join(F.broadcast(freq), "k").groupBy("example_id").agg(F.min(F.struct("freq", "k")).alias("r"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("example_id").cast("string"))), 1, 8), 16, 10).cast("long")
    rows = examples.select("example_id").join(rare, "example_id", "left").select("example_id", F.coalesce(F.col("r.k"), F.lit(-1)).alias("stratum"))
    total = examples.agg(F.count("*").alias("_n"))
    place = F.col("rank") / F.col("of")
    split = F.when(F.col("_n") < 10, "train").when(place < val, "val").when(place < val + test, "test").otherwise("train")
    return rank_within(rows, "stratum", u, "example_id").crossJoin(F.broadcast(total)).select("example_id", "stratum", split.alias("split"))


def pos_weights(examples: DataFrame, cap: float = POS_WEIGHT_CAP) -> DataFrame:
    """``label_id, weight``: negatives over positives, at most ``cap``."""
    g = examples.select(F.posexplode("labels").alias("label_id", "y")).groupBy("label_id").agg(F.count("*").alias("n"), F.sum("y").alias("p"))
    return g.select("label_id", F.when(F.col("p") == 0, cap).otherwise(F.least(F.try_divide((F.col("n") - F.col("p")).cast("double"), F.col("p")), F.lit(cap))).alias("weight"))


def weighted_bce(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """One row ``loss``: mean binary cross-entropy with positive weights and sample weights. ``predictions``: ``label_id, y, prob, weight``."""
    p = F.greatest(F.least(F.col("prob"), F.lit(1 - 1e-7)), F.lit(1e-7))
    term = -(F.col("pw") * F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p)) * F.col("weight")
    return predictions.join(F.broadcast(weights.select("label_id", F.col("weight").alias("pw"))), "label_id").agg(F.round(F.avg(term), 6).alias("loss"))


def f1_columns(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, zero where undefined."""
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def _sums(pred: Column) -> list[Column]:
    y = F.col("y") == 1
    return [F.sum((pred & y).cast("double")).alias("tp"), F.sum((pred & ~y).cast("double")).alias("fp"), F.sum((~pred & y).cast("double")).alias("fn")]


def label_metrics(predictions: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """``label, precision, recall, f1, support``; ``thresholds``: ``label, threshold``, one half where missing."""
    if thresholds is None:
        pred = F.col("prob") >= 0.5
    else:
        predictions = predictions.join(F.broadcast(thresholds), "label", "left")
        pred = F.col("prob") >= F.coalesce("threshold", F.lit(0.5))
    g = predictions.groupBy("label").agg(*_sums(pred), F.sum("y").cast("long").alias("support"))
    p, r, f = f1_columns(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select("label", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(f, 4).alias("f1"), "support")


def micro_macro(predictions: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """One row ``micro_f1, macro_f1, micro_precision, micro_recall``; the macro mean is over the whole taxonomy."""
    if thresholds is None:
        pred = F.col("prob") >= 0.5
    else:
        predictions = predictions.join(F.broadcast(thresholds), "label", "left")
        pred = F.col("prob") >= F.coalesce("threshold", F.lit(0.5))
    per = predictions.groupBy("label").agg(*_sums(pred))
    f = f1_columns(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    g = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), (F.sum(f) / len(LABELS)).alias("macro"))
    p, r, m = f1_columns(F.col("tp"), F.col("fp"), F.col("fn"))
    return g.select(F.round(m, 4).alias("micro_f1"), F.round("macro", 4).alias("macro_f1"), F.round(p, 4).alias("micro_precision"), F.round(r, 4).alias("micro_recall"))


def ece(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """One row ``ece``: expected calibration error over bins (lo, hi], the first one closed."""
    b = F.lit(0)
    for i in range(1, bins):
        b = F.when(F.col("prob") > i / bins, i).otherwise(b) if i == 1 else F.when(F.col("prob") > i / bins, i).otherwise(b)
    g = predictions.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("prob").alias("conf"), F.avg("y").alias("acc"))
    total = F.sum("n")
    return g.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / total, 4).alias("ece"))


def tune_thresholds(predictions: DataFrame) -> DataFrame:
    """``label, threshold, f1``: of 81 candidates the first with the best F1.

    Each prediction falls into the bin of the highest candidate it reaches; sums over bins give every
    candidate's counts, so that the grid isn't joined to the predictions.
    """
    lo, hi, n = THRESHOLDS
    step = (hi - lo) / (n - 1)
    bin_ = F.floor(F.round((F.col("prob") - lo) / step, 9)).cast("int")
    y = F.col("y").cast("double")
    g = predictions.groupBy("label", F.greatest(F.least(bin_, F.lit(n - 1)), F.lit(-1)).alias("bin")).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    # at most 82 bins a label
    dense = g.groupBy("label").agg(F.collect_list(F.struct("bin", "pos", "neg")).alias("b"), F.sum("pos").alias("all_pos")).select("label", "all_pos", "b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k"))
    above = F.filter("b", lambda x: x["bin"] >= F.col("k"))
    tp = F.aggregate(above, F.lit(0.0), lambda a, x: a + x["pos"])
    fp = F.aggregate(above, F.lit(0.0), lambda a, x: a + x["neg"])
    rows = dense.select("label", "k", tp.alias("tp"), fp.alias("fp"), (F.col("all_pos") - tp).alias("fn"))
    f = f1_columns(F.col("tp"), F.col("fp"), F.col("fn"))[2]
    best = rows.select("label", "k", F.round(f, 9).alias("f1")).groupBy("label").agg(F.max(F.struct("f1", (-F.col("k")).alias("k"))).alias("m"))
    return best.select("label", F.round(lo + step * -F.col("m.k"), 4).alias("threshold"), F.round("m.f1", 4).alias("f1"))


def slice_metrics(predictions: DataFrame, examples: DataFrame, least: int = 3) -> DataFrame:
    """``slice, f1, n`` per organisation, and for texts up to and above the median length. ``examples``: ``example_id, org, text``."""
    ex = examples.select("example_id", F.coalesce(F.nullif("org", F.lit("")), F.lit("unknown")).alias("org"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    median = ex.agg(F.percentile("chars", F.lit(0.5)).alias("mid"))
    tagged = ex.crossJoin(F.broadcast(median)).select("example_id", F.explode(F.array(F.concat(F.lit("org:"), "org"), F.when(F.col("chars") <= F.col("mid"), "doc:short").otherwise("doc:long"))).alias("slice"))
    per = predictions.groupBy("example_id").agg(*_sums(F.col("prob") >= 0.5))
    g = tagged.join(per, "example_id").groupBy("slice").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return g.select("slice", F.round(f1_columns(F.col("tp"), F.col("fp"), F.col("fn"))[2], 4).alias("f1"), "n")


def evaluate(predictions: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """One row of the summary figures and the calibration error."""
    return micro_macro(predictions, thresholds).crossJoin(ece(predictions))


def regression_gate(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """``label, baseline_f1, f1, passed`` per label and for ``macro``: label drops up to 0.03 and a macro drop up to 0.01 pass."""
    j = baseline.select("label", F.col("f1").alias("baseline_f1")).join(current.select("label", "f1"), "label", "left").withColumn("f1", F.coalesce("f1", F.lit(0.0)))
    per = j.select("label", "baseline_f1", "f1", (F.round(F.col("baseline_f1") - F.col("f1"), 4) <= MAX_LABEL_DROP).alias("passed"))
    macro = j.agg(F.round(F.avg("baseline_f1"), 4).alias("baseline_f1"), F.round(F.avg("f1"), 4).alias("f1")).select(F.lit("macro").alias("label"), "baseline_f1", "f1", (F.round(F.col("baseline_f1") - F.col("f1"), 4) <= MAX_MACRO_DROP).alias("passed"))
    return per.unionByName(macro)


def latency_stats(df: DataFrame, value: Column) -> DataFrame:
    v = df.select(value.cast("double").alias("v")).filter("v IS NOT NULL")
    pct = [F.round(F.percentile("v", F.lit(p)), 4).alias(f"p{int(p * 100)}") for p in (0.5, 0.95, 0.99)]
    return v.agg(F.round(F.avg("v"), 4).alias("mean"), *pct, F.round(F.min("v"), 4).alias("least"), F.round(F.max("v"), 4).alias("most"))


def parity(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float = 0.01) -> DataFrame:
    """One row ``max_diff, equal``: the largest difference between two scorers' results."""
    j = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys)
    return j.agg(F.round(F.max(F.abs(F.col("_a") - F.col("_b"))), 6).alias("max_diff")).select("max_diff", (F.col("max_diff") <= tolerance).alias("equal"))
