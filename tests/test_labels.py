"""Labelling functions, votes, agreement and sampling."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tailrace.operators import labels as ops
from tailrace.taxonomy import KEYWORDS, LABELS

CASES = [
    ("config-change", "A misconfiguration change in the load balancer caused 502 errors.", "The new code deploy introduced a regression in the payment flow."),
    ("retry-storm", "A retry storm from the API gateway overwhelmed the auth service.", "Traffic spiked 5x due to a viral marketing campaign."),
    ("cascading-failure", "The cascading failure took down three downstream services.", "The payment service experienced a timeout for 10 minutes."),
    ("dns", "DNS resolution failed, causing all API calls to timeout.", "The network link between the two data centers was severed."),
    ("certificate-expiry", "The TLS certificate expired, causing all HTTPS connections to fail.", "The OAuth token expired and users could not log in."),
    ("capacity-exhaustion", "The disk was full, causing the database to stop accepting writes.", "Response times increased by 200ms during peak hours."),
    ("bad-deploy", "The deploy contained a bug that caused null pointer exceptions.", "The environment variable was set to the wrong value."),
    ("dependency-failure", "An AWS us-east-1 outage caused our S3 uploads to fail.", "Our user service crashed due to a memory leak."),
    ("network-partition", "A split brain occurred between the two database replicas.", "The application timed out after 30 seconds waiting for a response."),
    ("database-failure", "A database deadlock caused all write operations to fail.", "The application was generating too many queries per request."),
    ("thundering-herd", "The thundering herd problem occurred when all instances reconnected.", "Traffic gradually increased over 2 hours during the sale event."),
    ("monitoring-gap", "No alerts were configured for the queue depth metric.", "The PagerDuty alert fired within 2 minutes of the error spike."),
    ("human-error", "An engineer accidentally deleted the production database table.", "The CI pipeline deployed a broken artifact to production."),
    ("data-corruption", "Data corruption caused 50,000 user records to have null emails.", "The database was unavailable for 2 hours but no data was lost."),
    ("quota-limit", "We hit the API rate limit, blocking all requests with 429 errors.", "The Redis instance ran out of memory during peak load."),
]
INCIDENT = "id string, title string, summary string, sections array<struct<name:string,text:string>>"
VOTE = "incident_id string, label string, lf_name string, positive boolean, confidence double"
LABEL = "incident_id string, label string, source string, annotator_id string"


def test_keywords_cover_the_taxonomy():
    assert tuple(x for x, _ in KEYWORDS) == LABELS


def test_keyword_votes(spark):
    rows = [(f"{label}+", "", pos, None) for label, pos, _ in CASES] + [(f"{label}-", None, neg, []) for label, _, neg in CASES]
    got = {(r["incident_id"], r["label"]): r for r in ops.keyword_votes(spark.createDataFrame(rows, INCIDENT)).collect()}
    assert len(got) == 30 * 15
    for label, _, _ in CASES:
        assert got[f"{label}+", label]["positive"] and got[f"{label}+", label]["confidence"] == 0.7, label
        assert not got[f"{label}-", label]["positive"] and got[f"{label}-", label]["confidence"] == 1.0, label


def test_root_cause_weighs_more(spark):
    df = spark.createDataFrame([("a", "t", "The service was down.", [("Root_Cause", "A DNS resolution failure caused timeouts.")])], INCIDENT)
    assert ops.keyword_votes(df).filter("label = 'dns'").head()["confidence"] == 0.9


def test_dot_does_not_cross_lines(spark):
    df = spark.createDataFrame([("a", "", "a feature flag\nwas wrong", None)], INCIDENT)
    assert not ops.keyword_votes(df).filter("label = 'config-change'").head()["positive"]


def test_silver(spark):
    v = spark.createDataFrame([("a", "dns", "x", True, 0.7), ("a", "dns", "y", True, 0.85), ("a", "bad-deploy", "x", True, 0.3), ("b", "dns", "x", False, 1.0)], VOTE)
    got = ops.silver_labels(v).collect()
    assert [(r["incident_id"], r["label"], r["confidence"], r["voters"]) for r in got] == [("a", "dns", 0.775, "x,y")]
    assert ops.silver_labels(v, min_voters=3).isEmpty()
    assert ops.silver_labels(v, threshold=0.0).count() == 2


def test_cooccurrence_and_coverage(spark):
    v = spark.createDataFrame([("a", "dns", "x", True, 0.7), ("a", "config-change", "x", True, 0.7), ("b", "dns", "x", True, 0.7)], VOTE)
    p = {(r["label_a"], r["label_b"]): r["p"] for r in ops.cooccurrence(v).collect()}
    assert len(p) == 225 and p["dns", "config-change"] == 0.5 and p["dns", "dns"] == 1.0 and p["quota-limit", "dns"] == 0.0
    assert set(r["p"] for r in ops.cooccurrence(v.limit(0)).collect()) <= {0.0}
    n = {r["label"]: r["n"] for r in ops.label_coverage(ops.silver_labels(v)).collect()}
    assert n["dns"] == 2 and n["quota-limit"] == 0 and len(n) == 15


def test_kappa_and_alpha(spark):
    def pair(a, b):
        rows = []
        for i, (x, y) in enumerate(zip(a, b)):
            for who, v in (("p", x), ("q", y)):
                rows.append((str(i), "dns" if v else "quota-limit", "human", who))
        return spark.createDataFrame(rows, LABEL)

    same = pair([1, 0, 1, 0], [1, 0, 1, 0])
    k = {r["label"]: r["kappa"] for r in ops.cohens_kappa(same).collect()}
    assert k["dns"] == 1.0 and k["bad-deploy"] == 1.0
    assert ops.krippendorff_alpha(same).head()["alpha"] == 1.0
    inverted = pair([1, 0, 1, 0], [0, 1, 0, 1])
    assert {r["label"]: r["kappa"] for r in ops.cohens_kappa(inverted).collect()}["dns"] < 0
    assert ops.krippendorff_alpha(same.limit(0)).head()["units"] == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=12))
def test_kappa_against_a_model(spark, pairs):
    rows = []
    for i, (x, y) in enumerate(pairs):
        for who, v in (("p", x), ("q", y)):
            rows.append((str(i), "dns" if v else "quota-limit", "human", who))
    n = len(pairs)
    po, p, q = sum(x == y for x, y in pairs) / n, sum(x for x, _ in pairs) / n, sum(y for _, y in pairs) / n
    pe = p * q + (1 - p) * (1 - q)
    want = 1.0 if pe == 1 else (po - pe) / (1 - pe)
    got = {r["label"]: r["kappa"] for r in ops.cohens_kappa(spark.createDataFrame(rows, LABEL)).collect()}["dns"]
    assert got == pytest.approx(want, abs=1e-6)


def test_sample(spark):
    inc = spark.createDataFrame([(str(i),) for i in range(20)], "id string")
    silver = spark.createDataFrame([(str(i), "dns") for i in range(12)] + [("13", "quota-limit")], "incident_id string, label string")
    got = ops.stratified_sample(inc, silver, 5).collect()
    assert len(got) == 5 and got[0]["id"] == "13"
    again = [r["id"] for r in ops.stratified_sample(inc, silver, 5).collect()]
    assert again == [r["id"] for r in got]
    done = spark.createDataFrame([("13",)], "incident_id string")
    assert "13" not in [r["id"] for r in ops.stratified_sample(inc, silver, 20, annotated=done).collect()]
    assert ops.stratified_sample(inc, silver, 99).count() == 20


def test_annotate_replaces_human_labels_only(spark):
    labels = spark.createDataFrame([("1", "dns", "human", "a", 1.0), ("1", "dns", "human", "b", 1.0), ("1", "dns", "weak", "w", 0.5), ("2", "dns", "human", "a", 1.0)], LABEL + ", confidence double")
    dec = spark.createDataFrame([("1", "a", [])], "incident_id string, annotator_id string, labels array<string>")
    got = {(r["incident_id"], r["annotator_id"], r["label"], r["source"]) for r in ops.annotate(labels, dec).collect()}
    assert got == {("1", "a", "__reviewed__", "human"), ("1", "w", "dns", "weak"), ("2", "a", "dns", "human")}


def test_votes_look_at_summary_and_title_apart(spark):
    df = spark.createDataFrame([("1", "error rose", "the team changed config", [])], INCIDENT)
    assert not [r for r in ops.keyword_votes(df).collect() if r["label"] == "config-change" and r["positive"]]
