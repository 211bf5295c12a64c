"""Weak supervision and annotation: labelling functions, votes, silver labels, agreement, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tailrace.session import small
from tailrace.taxonomy import KEYWORDS, LABELS, REVIEWED

SECTION_CONFIDENCE, BODY_CONFIDENCE, LLM_CONFIDENCE = 0.9, 0.7, 0.85
# fixed values: names of the section that weighs more
ROOT_CAUSE = ("root_cause", "root cause", "rootcause")
# fixed values: lower bounds of the verbal grades of kappa
KAPPA_BANDS = ((0.8, "Almost perfect"), (0.6, "Substantial"), (0.4, "Moderate"), (0.2, "Fair"), (0.0, "Slight"))


def taxonomy(spark) -> DataFrame:
    return spark.createDataFrame([(i, x) for i, x in enumerate(LABELS)], "label_id int, label string")


def keyword_votes(incidents: DataFrame) -> DataFrame:
    """``incident_id, label, lf_name, positive, confidence``: one row per incident and labelling function.

    A match in the root-cause section counts 0.9, one within the summary or within the title 0.7; an abstention has confidence 1.
    """
    cause = F.array_join(F.transform(F.filter("sections", lambda s: F.lower(s["name"]).isin(*ROOT_CAUSE)), lambda s: F.coalesce(s["text"], F.lit(""))), "\n")
    rows = incidents.select(F.col("id").alias("incident_id"), F.coalesce(cause, F.lit("")).alias("cause"), F.coalesce("summary", F.lit("")).alias("told"), F.coalesce("title", F.lit("")).alias("head"))
    votes = F.array(*[F.struct(F.lit(label).alias("label"), F.lit("kw_" + label.replace("-", "_")).alias("lf_name"), F.col("cause").rlike("(?id)" + p).alias("strong"), (F.col("told").rlike("(?id)" + p) | F.col("head").rlike("(?id)" + p)).alias("weak")) for label, p in KEYWORDS])
    flat = rows.select("incident_id", F.inline(votes))
    return flat.select("incident_id", "label", "lf_name", (F.col("strong") | F.col("weak")).alias("positive"), F.when(F.col("strong"), SECTION_CONFIDENCE).when(F.col("weak"), BODY_CONFIDENCE).otherwise(1.0).alias("confidence"))


def llm_votes(answers: DataFrame, name: str = "llm") -> DataFrame:
    """Votes of a language model: ``answers`` are ``incident_id, label`` that it listed; every other label is an abstention."""
    said = answers.select("incident_id", "label").filter(F.col("label").isin(*LABELS)).distinct().withColumn("positive", F.lit(True))
    asked = answers.select("incident_id").distinct().crossJoin(F.broadcast(taxonomy(answers.sparkSession).select("label")))
    j = asked.join(said, ["incident_id", "label"], "left")
    return j.select("incident_id", "label", F.lit(name).alias("lf_name"), F.coalesce("positive", F.lit(False)).alias("positive"), F.when(F.col("positive"), LLM_CONFIDENCE).otherwise(1.0).alias("confidence"))


def silver_labels(votes: DataFrame, min_voters: int = 1, threshold: float = 0.5) -> DataFrame:
    """``incident_id, label, confidence, voters``: labels with enough positive votes of enough mean confidence."""
    g = votes.filter("positive").groupBy("incident_id", "label").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"), F.array_join(F.sort_array(F.collect_set("lf_name")), ",").alias("voters"))
    return g.filter((F.col("n") >= min_voters) & (F.col("c") >= threshold)).select("incident_id", "label", F.round("c", 4).alias("confidence"), "voters")


def cooccurrence(votes: DataFrame) -> DataFrame:
    """``label_a, label_b, p``: share of all incidents with a positive vote for both; all pairs of the taxonomy, zeros included.

    Each incident is one set of at most as many labels as the taxonomy has, so its pairs are bounded.
    """
    spark = votes.sparkSession
    n = votes.agg(F.countDistinct("incident_id").alias("n"))
    sets = votes.groupBy("incident_id").agg(F.collect_set(F.when(F.col("positive"), F.col("label"))).alias("s"))
    pairs = sets.select(F.explode("s").alias("label_a"), "s").select("label_a", F.explode("s").alias("label_b")).groupBy("label_a", "label_b").agg(F.count("*").alias("k"))
    t = taxonomy(spark)
    grid = t.select(F.col("label").alias("label_a")).crossJoin(t.select(F.col("label").alias("label_b")))
    return grid.join(F.broadcast(pairs), ["label_a", "label_b"], "left").crossJoin(F.broadcast(n)).select("label_a", "label_b", F.coalesce(F.round(F.try_divide(F.col("k"), F.col("n")), 4), F.lit(0.0)).alias("p"))


def label_coverage(silver: DataFrame) -> DataFrame:
    counts = silver.groupBy("label").agg(F.count("*").alias("k"))
    return taxonomy(silver.sparkSession).join(F.broadcast(counts), "label", "left").select("label", F.coalesce("k", F.lit(0).cast("long")).alias("n"))


def coverage_report(silver: DataFrame, n_incidents: DataFrame, least: int = 30) -> DataFrame:
    """``label, n, pct, low``; ``n_incidents`` is one row with column ``total``."""
    return label_coverage(silver).crossJoin(F.broadcast(n_incidents)).select("label", "n", F.coalesce(F.round(F.try_divide(100.0 * F.col("n"), F.col("total")), 1), F.lit(0.0)).alias("pct"), (F.col("n") < least).alias("low"))


def reconcile(labels: DataFrame, silver: DataFrame) -> DataFrame:
    """``labels`` with all weak rows replaced by ``silver``."""
    kept = labels.filter("source IS NULL OR source <> 'weak'").select("incident_id", "label", "source", "confidence", "annotator_id")
    return kept.unionByName(silver.select("incident_id", "label", F.lit("weak").alias("source"), "confidence", F.lit("weak_supervision").alias("annotator_id")))


def annotate(labels: DataFrame, decisions: DataFrame) -> DataFrame:
    """All ``labels`` after ``decisions`` (``incident_id, annotator_id, labels``): the human labels of a decided incident are replaced by what was chosen, by the sentinel if that is nothing.

    Weak and model labels and those of other incidents stay, with all their columns; new rows have nulls in columns that a decision doesn't name.
    """
    decided = decisions.select(F.col("incident_id").alias("_decided")).distinct()
    kept = labels.join(decided, (F.col("incident_id") == F.col("_decided")) & (F.col("source") == "human"), "left_anti")
    chosen = F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit(REVIEWED)))
    fresh = decisions.select("incident_id", "annotator_id", F.explode(F.array_distinct(chosen)).alias("label"), F.lit("human").alias("source"), F.lit(1.0).alias("confidence"))
    return kept.unionByName(fresh, allowMissingColumns=True)


def next_unannotated(incidents: DataFrame, labels: DataFrame) -> DataFrame:
    """``annotator_id, done, next_id``: per annotator the number of annotated incidents and the first one, by id, without."""
    done = labels.filter("source = 'human' AND annotator_id IS NOT NULL").select("annotator_id", "incident_id").distinct()
    names = done.groupBy("annotator_id").agg(F.count("*").alias("_all"))
    seen = done.join(incidents.select(F.col("id").alias("incident_id")), "incident_id", "left_semi").groupBy("annotator_id").agg(F.count("*").alias("done"))
    # annotators are few: each is asked of every incident, and what remains shrinks to one row per task at once
    open_ = incidents.select("id").crossJoin(small(names.select("annotator_id"))).join(done, (F.col("id") == F.col("incident_id")) & (names["annotator_id"] == done["annotator_id"]), "left_anti")
    first = open_.groupBy("annotator_id").agg(F.min("id").alias("next_id"))
    return seen.join(first, "annotator_id", "left").select("annotator_id", "done", "next_id")


def stratified_sample(incidents: DataFrame, silver: DataFrame, n: int, seed: str = "42", annotated: DataFrame | None = None) -> DataFrame:
    """``id, label, round`` of at most ``n`` incidents: labels take turns, rare ones first, each picking by hash; then incidents without labels."""
    eligible = incidents.select("id") if annotated is None else incidents.select("id").join(annotated.select(F.col("incident_id").alias("id")).distinct(), "id", "left_anti")
    rows = eligible.join(silver.select(F.col("incident_id").alias("id"), "label").distinct(), "id", "left")
    freq = rows.filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("freq"))
    mark = F.md5(F.concat(F.lit(seed + ":"), F.coalesce("label", F.lit("")), F.lit(":"), "id"))
    w = Window.partitionBy("label").orderBy(mark, "id")
    ranked = rows.withColumn("round", F.row_number().over(w)).filter(F.col("round") <= n).join(F.broadcast(freq), "label", "left")
    last = F.lit(1 << 40)
    order = F.struct(F.when(F.col("label").isNull(), last).otherwise(F.lit(0).cast("long")).alias("late"), F.col("round").cast("long").alias("round"), F.coalesce("freq", last).alias("freq"), F.coalesce("label", F.lit("")).alias("label"))
    best = ranked.groupBy("id").agg(F.min(order).alias("o"))
    return best.select("id", F.col("o.label").alias("label"), F.col("o.round").cast("int").alias("round"), F.col("o.late").alias("late"), F.col("o.freq").alias("freq")).orderBy("late", "round", "freq", "label", "id").limit(n).select("id", "label", "round")


# -- agreement ---------------------------------------------------------------


def human_sets(labels: DataFrame) -> DataFrame:
    """``incident_id, annotator_id, label`` of human rows other than the sentinel, each once."""
    return labels.filter(f"source = 'human' AND label <> '{REVIEWED}' AND annotator_id IS NOT NULL").select("incident_id", "annotator_id", "label").distinct()


def _doubly(labels: DataFrame) -> DataFrame:
    sets = human_sets(labels).withColumn("annotator_id", F.lower(F.trim("annotator_id"))).distinct()
    twice = sets.groupBy("incident_id").agg(F.countDistinct("annotator_id").alias("m")).filter("m >= 2").select("incident_id", "m")
    return sets.join(twice, "incident_id")


def kappa(agree: Column, both1: Column, both2: Column, n: Column) -> Column:
    """Cohen's kappa from sums: agreements, positives of either annotator, items."""
    po, p1, p2 = agree / n, both1 / n, both2 / n
    pe = p1 * p2 + (1 - p1) * (1 - p2)
    return F.when(n == 0, 0.0).when(pe == 1.0, 1.0).otherwise((po - pe) / (1 - pe))


def cohens_kappa(labels: DataFrame) -> DataFrame:
    """``label, n, kappa`` of the two alphabetically first annotators over the incidents that both judged."""
    sets = _doubly(labels)
    names = sets.agg(F.slice(F.sort_array(F.collect_set("annotator_id")), 1, 2).alias("two"))
    judged = sets.crossJoin(F.broadcast(names)).filter(F.array_contains("two", F.col("annotator_id")))
    per = judged.groupBy("incident_id").agg(F.collect_set(F.when(F.col("annotator_id") == F.col("two")[0], F.col("label"))).alias("s1"), F.collect_set(F.when(F.col("annotator_id") == F.col("two")[1], F.col("label"))).alias("s2")).filter("size(s1) > 0 AND size(s2) > 0")
    flat = per.crossJoin(F.broadcast(taxonomy(labels.sparkSession).select("label"))).select("label", F.array_contains("s1", F.col("label")).cast("double").alias("y1"), F.array_contains("s2", F.col("label")).cast("double").alias("y2"))
    g = flat.groupBy("label").agg(F.count("*").alias("n"), F.sum((F.col("y1") == F.col("y2")).cast("double")).alias("a"), F.sum("y1").alias("p"), F.sum("y2").alias("q"))
    return g.select("label", "n", F.round(kappa(F.col("a"), F.col("p"), F.col("q"), F.col("n").cast("double")), 6).alias("kappa"))


def krippendorff_alpha(labels: DataFrame, standard: bool = False) -> DataFrame:
    """One row ``units, alpha`` over the incident x label units of incidents with two annotators or more.

    Observed disagreement is taken per unit, as the pipeline does; ``standard`` weighs units by their values, which differs with three annotators or more.
    """
    sets = _doubly(labels)
    m = sets.select("incident_id", F.col("m").cast("double").alias("m")).distinct()
    yes = sets.filter(F.col("label").isin(*LABELS)).groupBy("incident_id", "label").agg(F.countDistinct("annotator_id").cast("double").alias("y"))
    units = m.crossJoin(F.broadcast(taxonomy(labels.sparkSession).select("label"))).join(yes, ["incident_id", "label"], "left").select("m", F.coalesce("y", F.lit(0.0)).alias("y"))
    g = units.agg(F.count("*").alias("units"), F.sum(F.col("y") * (F.col("m") - F.col("y")) / (F.col("m") - 1)).alias("d"), F.sum("y").alias("ones"), F.sum("m").alias("values"))
    do = 2 * F.col("d") / F.col("values") if standard else F.col("d") / F.col("units")
    de = 2 * F.col("ones") * (F.col("values") - F.col("ones")) / (F.col("values") * (F.col("values") - 1))
    return g.select("units", F.round(F.when(F.col("units") == 0, 0.0).when(de == 0, 1.0).otherwise(1 - do / de), 6).alias("alpha"))


def kappa_band(x: Column) -> Column:
    out = F.when(x >= KAPPA_BANDS[0][0], KAPPA_BANDS[0][1])
    for low, name in KAPPA_BANDS[1:]:
        out = out.when(x >= low, name)
    return F.when(F.isnan(x), "Poor").otherwise(out.otherwise("Poor"))


def agreement_report(labels: DataFrame) -> DataFrame:
    """``label, n, kappa, grade, units, alpha``: Cohen's kappa of each label with its verbal grade, beside Krippendorff's alpha over all of them."""
    per = cohens_kappa(labels).select("label", "n", "kappa", kappa_band(F.col("kappa")).alias("grade"))
    return per.crossJoin(F.broadcast(krippendorff_alpha(labels)))  # one row
