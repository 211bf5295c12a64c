"""A consensus label from annotators who disagree: a mean-field variational confusion model.

Every annotator who looked at an incident says yes or no to each label of the taxonomy: one row holds an
incident with its annotators and, as bits, what each of them chose. Each label has a
prior of being true, each annotator a row of a confusion matrix for true and for false labels, all with
Dirichlet priors. An iteration derives the posterior of every label of an incident from the digammas of the expected
counts, and new counts by group-bys over annotators and labels; it stops when no weight changes any more.
Incidents that were judged alike (same annotators, same choices) are held once with their number.

Rows with a repeated annotator never arise, so a row is bounded by the number of annotators of one incident. The weights,
two numbers for each annotator, are sent along while there are at most ``MAX_ANNOTATORS``, else joined.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.session import materialize

#: Prior counts: an annotator is taken to be right four times in five until the data says otherwise.
RIGHT, WRONG = 4.0, 1.0
LABEL_YES, LABEL_NO = 1.0, 5.0
#: Iterations at most, and the largest change of a weight (in log odds) at which they stop.
ITERATIONS, CONVERGED = 100, 1e-3
#: Annotators whose weights are sent to every task at most: two numbers and a name each. Beyond it they are joined.
MAX_ANNOTATORS = 200_000
MAX_LABELS = 62


def digamma(x: Column) -> Column:
    """The digamma function of a positive column: recurrence up to x + 6, then the asymptotic series."""
    y = x + F.lit(6.0)
    series = F.log(y) - 0.5 / y - 1.0 / (12.0 * y * y) + 1.0 / (120.0 * y**4) - 1.0 / (252.0 * y**6)
    out = series
    for k in range(6):
        out = out - 1.0 / (x + F.lit(float(k)))
    return out


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.greatest(F.least(x, F.lit(700.0)), F.lit(-700.0))))


def spelled(label: Column) -> Column:
    """Taxonomy spelling: lower case, words joined by single hyphens, no blanks at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(label), "[\\s\\u00a0_-]+", "-"), "^-+|-+$", "")


def human_votes(labels: DataFrame, taxonomy: Sequence[str]) -> DataFrame:
    """``incident_id, votes``: of each annotator of an incident the labels chosen in the highest round, as bits in taxonomy order.

    A null round is below every other. Rows of other sources, without an incident or an annotator count for nobody.
    """
    rows = labels.filter(F.lower(F.trim("source")) == "human").select(
        "incident_id", F.lower(F.regexp_replace("annotator_id", "^[\\s\\u00a0]+|[\\s\\u00a0]+$", "")).alias("annotator"), spelled(F.col("label")).alias("label"), F.coalesce(F.col("annotation_round").cast("int"), F.lit(-1)).alias("round")
    ).filter("incident_id IS NOT NULL AND annotator IS NOT NULL AND annotator <> ''")
    bits = F.create_map(*[F.lit(x) for i, t in enumerate(taxonomy) for x in (t, 1 << i)]) if taxonomy else F.create_map().cast("map<string,bigint>")
    rounds = rows.groupBy("incident_id", "annotator", "round").agg(F.bit_or(F.coalesce(F.try_element_at(bits, F.col("label")).cast("long"), F.lit(0).cast("long"))).alias("chosen"))
    # at most as many as the incident has annotators, times their rounds
    each = rounds.groupBy("incident_id").agg(F.sort_array(F.collect_list(F.struct("annotator", "round", "chosen"))).alias("v"))
    last = F.filter("v", lambda x, i: (i == F.size("v") - 1) | (F.get("v", i + 1)["annotator"] != x["annotator"]))
    return each.select("incident_id", F.transform(last, lambda x: F.struct(x["annotator"].alias("a"), x["chosen"].alias("m"))).alias("votes"))


_SUMS = "kind string, key string, yt double, nt double, yf double, nf double"


def _bit_sum(i: int):
    return lambda total, v: total + F.shiftright(v["m"], i).bitwiseAND(1).cast("double")


class _Votes:
    """The votes of a batch as arrays: per vote its row, its annotator and a yes or no for each label."""

    def __init__(self, votes: pa.Array, n_labels: int):
        flat = votes.flatten()
        names = flat.field("a").dictionary_encode()
        self.names = names.dictionary.to_pylist()
        self.who = names.indices.to_numpy(zero_copy_only=False)
        self.row = np.repeat(np.arange(len(votes)), votes.value_lengths().to_numpy(zero_copy_only=False))
        masks = flat.field("m").to_numpy(zero_copy_only=False)
        self.yes = ((masks[:, None] >> np.arange(n_labels)) & 1).astype(np.float64)
        self.n = np.bincount(self.row, minlength=len(votes)).astype(np.float64)
        self.n_yes = self.by_row(self.yes)

    def by_row(self, values: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.row, weights=v, minlength=len(self.n)) for v in values.T], axis=1) if values.shape[1] else np.zeros((len(self.n), 0))

    def posterior(self, weights: tuple[dict, np.ndarray] | None) -> np.ndarray:
        """The share of yes before the first iteration, then what the weights and priors say."""
        if weights is None:
            return self.n_yes / self.n[:, None]
        table, prior = weights
        w = np.array([table[a] for a in self.names]).reshape(-1, 2)[self.who]
        odds = self.by_row(w[:, 1:] + self.yes * (w[:, :1] - w[:, 1:])) + prior
        return 1.0 / (1.0 + np.exp(-np.clip(odds, -700, 700)))


def _expect(weights, labels: Sequence[str]):
    """Expected counts of a task by annotator (yes|true, no|true, yes|false, no|false) and by label (true, false)."""

    def run(batches):
        sums: dict = {}
        given = weights.value if weights is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _Votes(batch.column(batch.schema.get_field_index("votes")), len(labels))
            items = batch.column(batch.schema.get_field_index("items")).to_numpy(zero_copy_only=False).astype(np.float64)
            q = v.posterior(given)
            t = q[v.row] * items[v.row, None]
            f = items[v.row, None] - t
            parts = ((v.yes * t).sum(1), ((1 - v.yes) * t).sum(1), (v.yes * f).sum(1), ((1 - v.yes) * f).sum(1))
            per = np.stack([np.bincount(v.who, weights=p, minlength=len(v.names)) for p in parts], axis=1)
            for name, row in zip(v.names, per):
                sums["annotator", name] = sums.get(("annotator", name), 0) + row
            true = (q * items[:, None]).sum(0)
            for label, a in zip(labels, true.tolist()):
                sums["label", label] = sums.get(("label", label), 0) + np.array([a, items.sum() - a, 0, 0])
        rows = list(sums.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string())] + [pa.array([float(x[j]) for _, x in rows], pa.float64()) for j in range(4)], ["kind", "key", "yt", "nt", "yf", "nf"])

    return run


def _chosen(weights, labels: Sequence[str]):
    """The labels true by consensus of each incident."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _Votes(batch.column(batch.schema.get_field_index("votes")), len(labels))
            q = v.posterior(weights.value)
            at, label = np.nonzero(q > 0.5)
            ids = batch.column(batch.schema.get_field_index("incident_id"))
            agreement = v.n_yes[at, label] / v.n[at]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([labels[j] for j in label], pa.string()), pa.array(q[at, label]), pa.array(agreement)], ["incident_id", "label", "posterior", "agreement"])

    return run


class Consensus:
    """``labels``: ``incident_id, label, source, annotator_id, annotation_round``; ``taxonomy``: the labels that exist, at most ``MAX_LABELS``.

    Labels outside the taxonomy, and null ones, count as having looked. An incident nobody judged has no
    row; ties (posterior of exactly one half) are no consensus; repeated rows count once; an empty table
    gives empty results; further columns are ignored.
    """

    def __init__(self, labels: DataFrame, taxonomy: Sequence[str], iterations: int = ITERATIONS, converged: float = CONVERGED):
        if len(taxonomy) > MAX_LABELS:
            raise ValueError(f"more than {MAX_LABELS} labels")
        self.taxonomy = list(taxonomy)
        #: ``incident_id, votes``: one row for each judged incident.
        self.items = materialize(human_votes(labels, self.taxonomy), "votes")
        #: ``votes, items``: the answers of each distinct pattern.
        self.patterns = materialize(self.items.groupBy("votes").agg(F.count("*").alias("items")), "patterns")
        self.few = self.patterns.select(F.explode("votes.a").alias("a")).distinct().count() <= MAX_ANNOTATORS
        #: Iterations made, and the largest change of a weight in the last one.
        self.iterations, self.change = 0, float("inf")
        self._state = self._expected(None)
        while self.iterations < iterations and self.change > converged:
            new = self._expected(self._state)
            self.change = self._difference(self._state, new)
            self._state = new
            self.iterations += 1

    def _expected(self, state) -> list | DataFrame:
        """One pass over the patterns: ``kind, key``, the expected counts ``yt, nt, yf, nf`` and the weights that follow from them.

        Rows on the driver while annotators are few, else a table.
        """
        if self.few:
            found = self.patterns.mapInArrow(_expect(self._sent(state), self.taxonomy), _SUMS)
            return self._weighed(found.groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in ("yt", "nt", "yf", "nf")])).collect()
        rows = self._answers(self.patterns.withColumn("row", F.monotonically_increasing_id()), state)
        rows = materialize(rows.select("a", "label", "yes", (F.col("items") * F.col("q")).alias("t"), (F.col("items") * (1 - F.col("q"))).alias("f"), "first"), "answers")

        def total(yes: bool, of: str) -> Column:
            return F.sum(F.when(F.col("yes") == yes, F.col(of)).otherwise(0.0))

        people = rows.groupBy(F.col("a").alias("key")).agg(total(True, "t").alias("yt"), total(False, "t").alias("nt"), total(True, "f").alias("yf"), total(False, "f").alias("nf"))
        kinds = rows.filter("first").groupBy(F.col("label").alias("key")).agg(F.sum("t").alias("yt"), F.sum("f").alias("nt"), F.lit(0.0).alias("yf"), F.lit(0.0).alias("nf"))
        return materialize(self._weighed(people.select(F.lit("annotator").alias("kind"), "*").unionByName(kinds.select(F.lit("label").alias("kind"), "*"))), "expected")

    def _answers(self, rows: DataFrame, weights: DataFrame | None) -> DataFrame:
        """Every answer of ``rows`` (``row, votes``) to every label with the posterior ``q`` of that label, by joins: with any number of annotators."""
        each = rows.select(*[c for c in rows.columns if c != "votes"], F.posexplode("votes").alias("pos", "vote"))
        labels = F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(t).alias("label")) for i, t in enumerate(self.taxonomy)])
        each = each.select(*[c for c in each.columns if c not in ("pos", "vote")], (F.col("pos") == 0).alias("first"), F.col("vote.a").alias("a"), F.col("vote.m").alias("m"), F.inline(labels)).withColumn("yes", F.expr("(shiftright(m, bit) & 1) = 1"))
        if weights is None:
            q = each.groupBy("row", "label").agg(F.avg(F.col("yes").cast("double")).alias("q"))
        else:
            w = weights.filter("kind = 'annotator'").select(F.col("key").alias("a"), "if_yes", "if_no")
            p = weights.filter("kind = 'label'").select(F.col("key").alias("label"), "prior")
            q = each.join(w, "a").groupBy("row", "label").agg(F.sum(F.when(F.col("yes"), F.col("if_yes")).otherwise(F.col("if_no"))).alias("s"))
            q = q.join(F.broadcast(p), "label").select("row", "label", logistic(F.col("s") + F.col("prior")).alias("q"))
        return each.join(q, ["row", "label"])

    @staticmethod
    def _weighed(c: DataFrame) -> DataFrame:
        """``c`` with ``if_yes, if_no``, what an answer of an annotator adds to the log odds of a label, and ``prior``, the log odds of a label before any answer."""
        yt, nt, yf, nf = F.col("yt") + RIGHT, F.col("nt") + WRONG, F.col("yf") + WRONG, F.col("nf") + RIGHT
        t, f = digamma(yt + nt), digamma(yf + nf)
        person = F.col("kind") == "annotator"
        prior = digamma(F.col("yt") + LABEL_YES) - digamma(F.col("nt") + LABEL_NO)
        return c.select("*", F.when(person, digamma(yt) - t - digamma(yf) + f).alias("if_yes"), F.when(person, digamma(nt) - t - digamma(nf) + f).alias("if_no"), F.when(~person, prior).alias("prior"))

    def _difference(self, old, new) -> float:
        """The largest change of a weight."""
        if self.few:
            was = {(r["kind"], r["key"]): r for r in old}
            return max((abs((r[c] or 0.0) - (was[r["kind"], r["key"]][c] or 0.0)) for r in new for c in ("if_yes", "if_no", "prior")), default=0.0)
        o = old.select("kind", "key", F.col("if_yes").alias("y"), F.col("if_no").alias("n"), F.col("prior").alias("p"))
        gap = F.greatest(F.abs(F.col("if_yes") - F.col("y")), F.abs(F.col("if_no") - F.col("n")), F.abs(F.col("prior") - F.col("p")))
        return new.join(o, ["kind", "key"]).agg(F.max(gap)).head()[0] or 0.0

    def _sent(self, state):
        """The weights as a broadcast: at most ``MAX_ANNOTATORS`` rows and the taxonomy."""
        if state is None:
            return None
        prior = {r["key"]: r["prior"] for r in state if r["kind"] == "label"}
        table = {r["key"]: (r["if_yes"], r["if_no"]) for r in state if r["kind"] == "annotator"}
        return self.items.sparkSession.sparkContext.broadcast((table, np.array([prior.get(t, 0.0) for t in self.taxonomy])))

    def labels(self) -> DataFrame:
        """``incident_id, label, posterior, agreement``: labels true by consensus; agreement is the share of the incident's annotators who chose it."""
        if self.few:
            return self.items.mapInArrow(_chosen(self._sent(self._state), self.taxonomy), "incident_id string, label string, posterior double, agreement double")
        each = self._answers(self.items.withColumn("row", F.col("incident_id")), self._state)
        return each.groupBy("incident_id", "label").agg(F.first("q").alias("posterior"), F.avg(F.col("yes").cast("double")).alias("agreement")).filter("posterior > 0.5")

    def annotators(self) -> DataFrame:
        """``annotator, sensitivity, specificity`` with posterior 95 % bounds of each (normal approximation), and ``answers``."""
        table = self.items.sparkSession.createDataFrame(self._state, f"{_SUMS}, if_yes double, if_no double, prior double") if self.few else self._state
        r = table.filter("kind = 'annotator'").select(F.col("key").alias("annotator"), (F.col("yt") + RIGHT).alias("yt"), (F.col("nt") + WRONG).alias("nt"), (F.col("yf") + WRONG).alias("yf"), (F.col("nf") + RIGHT).alias("nf"))

        def beta(a: str, b: str, name: str) -> list[Column]:
            n = F.col(a) + F.col(b)
            mean = F.col(a) / n
            sd = F.sqrt(mean * (1 - mean) / (n + 1))
            return [mean.alias(name), F.greatest(F.lit(0.0), mean - 1.96 * sd).alias(f"{name}_low"), F.least(F.lit(1.0), mean + 1.96 * sd).alias(f"{name}_high")]

        answers = (F.col("yt") + F.col("nt") + F.col("yf") + F.col("nf") - 2 * (RIGHT + WRONG)).alias("answers")
        return r.select("annotator", *beta("yt", "nt", "sensitivity"), *beta("nf", "yf", "specificity"), answers)

    def agreement(self) -> DataFrame:
        """Krippendorff's alpha (nominal) for each label: ``label, items, alpha``, over items with two annotators or more."""
        several = self.patterns.filter(F.size("votes") >= 2)
        n, k = F.size("votes").cast("double"), F.col("items").cast("double")
        sums = []
        for i, _ in enumerate(self.taxonomy):
            y = F.col(f"y{i}")
            sums.append(F.struct((F.sum(k * 2 * y * (n - y) / (n - 1))).alias("diff"), F.sum(k * y).alias("ones")))
        ones = [F.aggregate("votes", F.lit(0.0), _bit_sum(i)).alias(f"y{i}") for i, _ in enumerate(self.taxonomy)]
        g = several.select("votes", "items", *ones).agg(F.sum("items").alias("items"), F.sum(k * n).alias("values"), F.array(*[F.struct(F.lit(t).alias("label"), s.alias("s")) for t, s in zip(self.taxonomy, sums)]).alias("by"))
        g = g.filter("items > 0").select("items", "values", F.inline("by")).select("label", "items", "values", F.col("s.diff").alias("diff"), F.col("s.ones").alias("ones"))
        expected = 2 * F.col("ones") * (F.col("values") - F.col("ones")) / (F.col("values") - 1)
        return g.select("label", "items", F.when(expected > 0, 1 - F.col("diff") / expected).otherwise(F.lit(1.0)).alias("alpha"))
