"""Leaked passages, mixtures and truncated texts."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tailrace.llm import leaks, mixing, truncation

from . import helpers as h

DOC = "doc_id bigint, text string, source string"
ITEM = "item_id bigint, text string"


def edit_distance(pattern, text):
    """Least edits between a pattern and any stretch of a text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=14))
def test_myers(p, t):
    assert leaks.myers(p, t) == edit_distance(p, t)


def test_pieces_cover_every_run():
    for n in range(1, 40):
        ws = [str(i) for i in range(n)]
        spans = [(a, a + len(p)) for a, p in leaks.pieces(ws)]
        assert {i for a, b in spans for i in range(a, b)} == set(range(n))
        for s in range(n - leaks.RUN + 1):
            assert any(s <= a and b <= s + leaks.RUN for a, b in spans)


def fixture():
    r = h.rng(9)
    items = [(i, " ".join(h.sentence(r) for _ in range(4))) for i in range(12)] + [(50, None), (51, ""), (52, "only five words stand here")]
    docs = []
    for d in range(60):
        ws = h.report(r, 8).split(" ")
        if d % 3 == 0:
            item = items[d % 12][1].split(" ")
            n = r.randrange(6, 25)
            s = r.randrange(len(item) - n)
            ws[20:20] = item[s : s + n]
        docs.append((d, " ".join(ws), "s"))
    docs += [(100, None, "s"), (101, "", None), (102, items[3][1], "s"), (103, items[4][1].upper().replace(" ", " -- "), "s"), (104, "So only five words stand here now", "s"), (105, h.edited(r, items[5][1], 3), "s")]
    return docs, items


def test_leaks(spark):
    docs, items = fixture()
    want = set()
    for d, t, _ in docs:
        for i, u in items:
            a, b = h.words(t or ""), h.words(u or "")
            runs = {tuple(b[k : k + 13]) for k in range(len(b) - 12)}
            if runs & {tuple(a[k : k + 13]) for k in range(len(a) - 12)}:
                want.add((d, i))
    df, it = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    rows = leaks.leaked(df, it).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows if r["run"] >= 13} == want == {(r["doc_id"], r["item_id"]) for r in rows if r["run_edits"] == 0}
    assert all(r["run_edits"] is None for r in rows if r["item_words"] < leaks.RUN)
    by = {(r["doc_id"], r["item_id"]): r for r in rows}
    assert by[102, 3]["edits"] == 0 and by[103, 4]["edits"] == 0 and by[104, 52]["edits"] == 0 and by[105, 5]["edits"] <= 3
    assert (105, 5) in {(r["doc_id"], r["item_id"]) for r in leaks.leaked_passages(df, it).collect()}


def test_leaks_in_blocks(spark, monkeypatch):
    docs, items = fixture()
    df, it = spark.createDataFrame(docs, DOC).withColumnRenamed("source", "run"), spark.createDataFrame(items, ITEM)
    whole = sorted(map(tuple, leaks.leaked(df, it).collect()))
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 60)
    assert sorted(map(tuple, leaks.leaked(df, it).collect())) == whole
    assert leaks.leaked(df.limit(0), it).isEmpty() and leaks.leaked(df, it.limit(0)).isEmpty()


needs_tokenizer = pytest.mark.skipif(not os.path.exists(mixing.VOCABULARY), reason="no tokenizer files here")
TARGET = "source string, target_share double, max_repeats int"


@needs_tokenizer
def test_mix(spark):
    r = h.rng(4)
    docs = [(i, h.report(r, 3), ("a", "a", "a", "b")[i % 4]) for i in range(2000)] + [(9000, None, "a"), (9001, "x", None), (9002, "x", "unlisted"), (9003, "", "b")]
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.3, 4), ("c", 0.3, 2), (None, 0.5, 1), ("d", None, 1)], TARGET)
    df = spark.createDataFrame(docs, DOC)
    m = mixing.Mix(df, targets)
    rates = {x["source"]: x for x in m.rates.collect()}
    total = sum(x["tokens"] for x in rates.values())
    assert set(rates) == {"a", "b", "c"} and rates["c"]["short"] and not rates["a"]["short"] and not rates["b"]["short"]
    assert rates["a"]["rate"] == pytest.approx(0.4 * total / rates["a"]["tokens"])
    shares = {x["source"]: x["actual_share"] for x in m.shares().collect()}
    assert shares["a"] / shares["b"] == pytest.approx(0.4 / 0.3, rel=0.1) and shares["c"] == 0 and sum(shares.values()) == pytest.approx(1)
    n = m.copies().count()
    assert n == mixing.Mix(df, targets).copies().count() and m.documents().count() == m.copies().groupBy().sum("copies").head()[0]
    assert set(m.documents().columns) == {*df.columns, "copy_no"}
    assert mixing.Mix(df.limit(0), targets).copies().isEmpty() and mixing.Mix(df, targets.limit(0)).rates.isEmpty()


@needs_tokenizer
def test_tokens(spark):
    enc = mixing.encoder(mixing.VOCABULARY)
    t = "It broke — für 3 Stunden. <|endoftext|>"
    assert enc.decode(enc.encode_ordinary(t)) == t
    got = mixing.token_counts(spark.createDataFrame([(1, t, "s")], DOC)).head()["tokens"]
    assert got == len(enc.encode_ordinary(t))


def texts():
    r = h.rng(6)
    rows, cut = [], set()
    for i in range(900):
        lines = ["Why it broke", *[" ".join(h.sentence(r) for _ in range(3)) for _ in range(3)], "## To do", *[f"- check the {r.choice(h.NOUNS)} of {r.choice(h.NOUNS)} with the {r.choice(h.NOUNS)} team" for _ in range(3)]]
        t = "\n".join(lines)
        if i % 10 == 0:
            body = "\n".join(lines[:4])
            t = body[: r.randrange(150, len(body) - 12)].rstrip(" .")
            t += ("", " [...]", "…")[i % 3]
            cut.add(i)
        elif i % 10 == 1:
            t = t[:-5]
            t = t[: t.rindex(" ") + 3]
            cut.add(i)
        elif i % 10 == 2:
            t += "\n\nEnd of report"
        elif i % 10 == 3:
            t += "\nhttps://x.example/i/12"
        rows.append((i, t, "s" if i % 2 else None))
    return rows + [(5000, None, "s"), (5001, "", "s"), (5002, " \n ", "s"), (5003, "…", "s")], cut


def test_truncated(spark):
    rows, cut = texts()
    got = {r["doc_id"] for r in truncation.truncated(spark.createDataFrame(rows, DOC)).collect()}
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut) <= 0.02 * len(rows)


def test_truncation_rates(spark):
    rows, cut = texts()
    df = spark.createDataFrame([(*r, 1) for r in rows], DOC + ", kind int")
    got = {r["source"]: r for r in truncation.truncation_rates(df).collect()}
    assert got["s"]["n_docs"] == 454 and got[None]["n_docs"] == 450 and got["s"]["n_truncated"] == 90
    assert truncation.truncated(df.limit(0)).isEmpty()


def test_one_ending_is_judged_alike(spark):
    """A whole ending without a stop is whole in 3, 6 and 40 documents; one ending that goes on elsewhere is cut in all of them."""
    rows, _ = texts()
    r = h.rng(21)
    signs = {n: f"Written for all of our readers by the {w} people of the {w} desk {w}" for n, w in ((3, "quill"), (6, "ambry"), (40, "zinco"))}
    at = 20_000
    whole, cut = {n: set() for n in signs}, {n: set() for n in signs}
    for n, line in signs.items():
        for _ in range(n):
            rows.append((at, h.report(r, r.randrange(3, 9)) + "\n" + line, "s"))
            whole[n].add(at)
            rows.append((at + 1, h.report(r, r.randrange(3, 9)) + f" Then all of the {n} teams had to move over", "s"))
            cut[n].add(at + 1)
            rows += [(at + 2 + j, h.report(r, 2) + f" Then all of the {n} teams had to move over to the other hall." * 15 + h.sentence(r), "s") for j in range(2)]
            at += 10
    got = {x["doc_id"] for x in truncation.truncated(spark.createDataFrame(rows, DOC)).collect()}
    assert not any(v & got for v in whole.values()) and all(v <= got for v in cut.values())


def test_long_words(spark):
    """Pieces of eight letters and more are found in longer words; a word of a million letters does no harm."""
    r = h.rng(22)
    rows = [(i, h.report(r, 3) + "\n- restart the datenbankverbindungsueberwachungsdienst", "s") for i in range(20)]
    rows += [(100, h.report(r, 3) + "\n- restart the datenbankverbindungsueberwa", "s"), (101, "x" * 1_000_000, "s"), (102, "- " + "x" * 900_000, "s")]
    got = {x["doc_id"] for x in truncation.truncated(spark.createDataFrame(rows, DOC)).collect()}
    assert 100 in got and not got & set(range(20))


def test_copies_of_a_cut_text(spark):
    rows, cut = texts()
    hot = next(t for i, t, _ in rows if i in cut and i % 30 == 0)
    more = [(10_000 + i, hot, "s") for i in range(450)]
    got = {r["doc_id"] for r in truncation.truncated(spark.createDataFrame(rows + more, DOC)).collect()}
    assert {i for i, _, _ in more} <= got and len(got & cut) >= 0.95 * len(cut)


def test_cuts_at_the_same_words(spark):
    """In large tables many texts are cut at the same words or in the same number; that doesn't make these an ending."""
    rows, _ = texts()
    r = h.rng(23)
    story = "For background, the northgate serves 482,113 readers from the hall. Next time the desk has to move over."
    rows += [(20_000 + i, " ".join([h.report(r, 2), *[story] * 8, h.report(r, 1)]), "s") for i in range(250)]
    ways = {
        "number": story[: story.index("82,113")],
        "number after a comma": story[: story.index("113")],
        "first word": story[: story.index(" time")],
        "second word": story[: story.index(" the desk")],
        "before the stop": story[:-1],
        "piece": "For background, the northg",
        "piece with a mark": "For background, the northg (more)",
    }
    cut = {w: {30_000 + 100 * k + i for i in range(8)} for k, w in enumerate(ways)}
    for w, end in ways.items():
        rows += [(i, f"{h.report(r, r.randrange(2, 9))} {end}", "s") for i in cut[w]]
    cut["one short line"] = {40_000 + i for i in range(8)}
    rows += [(40_000 + i, f"F{'o' * i}r background, the northgate serves", "s") for i in range(8)]
    whole = set(range(50_000, 50_060))
    rows += [(i, h.report(r, r.randrange(2, 9)) + ("\nThanks for reading", f"\nTicket northgate/{r.randrange(1, 900)}", "\nReported by the desk")[i % 3], "s") for i in whole]
    got = {x["doc_id"] for x in truncation.truncated(spark.createDataFrame(rows, DOC)).collect()}
    assert {w: len(v - got) for w, v in cut.items() if v - got} == {} and not whole & got
