"""Text cut off by field limits, found by what texts usually go on with, in plain SQL.

Texts are cut into lines, lines into words; digits are masked in their shape, so that a cut number shows. All
word trigrams are counted by where they stand: inside (another word follows), or at an end (of a line or the
text, without a stop), for prose and for other lines (items, timelines, commands) apart. Counts are combined in each
task first, so what is shuffled are distinct trigrams. Each text's last trigram is then joined to them:

* it is frequent inside and almost never at an end: cut in a sentence. Where the trigram is too rare to say, its last
  two words decide, then its last, then all words of its kind of line. In large tables cuts meet at the same words, so
  that rare runs of one kind of line look terminal: a tiny share among many uses in all lines outweighs that.
* its last word hardly stands there otherwise, but longer words (or numbers) that begin with it do: cut in a word.

Ends of texts of one source and one length count once: so end the copies that one field limit cut. A mark of the cut
(an ellipsis and the like) is put aside first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tailrace.session import materialize

#: Below this share of uses at an end, a run of words is "almost never terminal".
END_SHARE = 0.05
#: Uses, beside the text's own, from which a run of words is judged by its own counts.
ENOUGH = 2
#: A cut word stands at ends at most this often, against the longer words it may have been.
PIECE_SHARE = 0.05
#: Below this share of uses in all kinds of line, of at least ``1 / RARE_SHARE``, ends are where cuts happened to fall.
RARE_SHARE = 0.005
LONG_LINE = 8
#: A mark of the cut lies within so many characters of the end.
TAIL = 40
#: Characters by which longer words are looked up; starts below that length are listed one by one.
PREFIX = 8

_BLANK = " \t\r\n\f\u00a0"

# fixed patterns
_MARK = r"(?:\s*(?:\[\s*(?:\.{2,}|…|truncated|cut|more)\s*\]|\(\s*(?:\.{3}|…|truncated|more)\s*\)|…|\.{3,}|\x{FFFD}|<truncated>|\[\+\d+ chars\]))+\s*$"
_NUMBER = "^[0_]+$"
_ENDED = r"[.!?][\"'”’)\]*_]*$"
_OTHER = r"^(?:\s*(?:[-*•+–—]|\d{1,3}[.)])\s|\s*\d{1,2}:\d{2}\b|    |\s*#|https?://)"

def _word_array(line: str) -> str:
    """SQL for the words of a line, digits as 0 and the punctuation inside numbers as _; sentence ends are words ``.``, and an empty word may stand at either end."""
    masked = f"translate(lower({line}), '123456789', '000000000')"
    numbers = f"regexp_replace(regexp_replace({masked}, '(0)[.,:/-](0)', '$1_$2'), '(0)[.,:/-](0)', '$1_$2')"
    return f"split(regexp_replace({numbers}, '[.!?]+(\\\\s|$)', ' . $1'), '[^\\\\p{{L}}0._]+')"


def _ended(line: Column) -> Column:
    """Whether a line ends with a stop."""
    return F.right(F.rtrim(line, F.lit(_BLANK)), F.lit(8)).rlike(_ENDED)


def _kind(line: Column) -> Column:
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(F.substring(line, 1, 16).rlike(_OTHER), "other").when(spaces >= LONG_LINE - 1, "prose").otherwise("short")


def _once(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with ``columns`` computed once per row: an explode of one element keeps the optimizer from repeating them wherever they are named."""
    for c in columns:
        df = df.select(*[x for x in df.columns if x != c], F.explode(F.array(c)).alias(c))
    return df


def truncation_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(trigram counts ``kind, a, b, c, inside, ends, stops``, last trigrams ``doc_id, kind, a, b, c, marked, ended``).

    Ends of whole texts aren't counted yet, and ``last`` has a hash of its source and length in ``same``. The counting plan keeps to expressions that Spark compiles: no lambda runs per word.
    """
    source = F.col("source") if "source" in docs.columns else F.lit(None).cast("string").alias("source")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source, F.trim("text", F.lit(_BLANK)).alias("text")).filter("text <> ''")
    whole = _once(whole, "text")
    # only the last characters are searched for a mark: the patterns would be tried at every place of a text
    tail = F.right("text", F.lit(TAIL))
    bare = F.rtrim(F.concat(F.substr("text", F.lit(1), F.greatest(F.length("text") - TAIL, F.lit(0))), F.regexp_replace(tail, _MARK, "")), F.lit(_BLANK))
    cut = _once(whole.select("doc_id", "source", "text", tail.rlike(_MARK).alias("marked")), "marked")
    cut = _once(cut.select("doc_id", "source", "marked", F.when(F.col("marked"), bare).otherwise(F.col("text")).alias("body")), "body")

    split = cut.select(F.split("body", "\n").alias("all"))
    lines = split.select("all", F.posexplode_outer("all").alias("pos", "line")).select((F.size("all") - 1).alias("last"), "pos", "line")
    title = (F.col("last") > 0) & (F.col("pos") == 0) & ~_ended(F.col("line"))
    words = lines.select(F.when(title, "title").otherwise(_kind(F.col("line"))).alias("kind"), (F.col("pos") == F.col("last")).alias("final"), F.expr(_word_array("line")).alias("w"))
    # outer: the plain explode would be given a filter that cuts every line a second time
    at = words.select("kind", "final", "w", F.posexplode_outer("w").alias("i", "c")).filter("c <> '' AND c <> '.'")
    a, b, d = F.get("w", F.col("i") - 2), F.get("w", F.col("i") - 1), F.get("w", F.col("i") + 1)
    fresh = b.isNull() | b.isin("", ".")  # a sentence or line begins here
    shaped = at.select("kind", F.when(fresh | a.isNull() | a.isin("", "."), "^").otherwise(a).alias("a"), F.when(fresh, "^").otherwise(b).alias("b"), "c", (d.isNull() | (d == "")).alias("end"), (d == ".").alias("stop"), "final")
    counts = shaped.groupBy("kind", "a", "b", "c").agg(F.count_if(~F.col("end") & ~F.coalesce("stop", F.lit(False))).alias("inside"), F.count_if(F.col("end") & ~F.col("final")).alias("ends"), F.count_if(F.coalesce("stop", F.lit(False))).alias("stops"))

    last_line = F.substring_index("body", "\n", -1)
    wordy = F.try_element_at(F.filter(F.split("body", "\n"), lambda x: x.rlike(r"[\p{L}\p{N}]")), F.lit(-1))
    final = cut.select("doc_id", "marked", F.xxhash64("source", F.length("body")).alias("same"), F.when(last_line.rlike(r"[\p{L}\p{N}]"), last_line).otherwise(wordy).alias("line"))
    final = _once(final, "line").select("doc_id", "marked", "same", _kind(F.col("line")).alias("kind"), _ended(F.col("line")).alias("ended"), F.filter(F.expr(_word_array("line")), lambda x: x != "").alias("v"))
    # words by their place before the last one, cut at sentence ends as in the counts
    at = F.array_position(F.transform(F.reverse("v"), lambda x: x != "."), True)
    final = _once(final.select("*", F.expr("reverse(v)").alias("r"), at.cast("int").alias("at")).drop("v"), "r").filter("at > 0")
    a, b = F.get("r", F.col("at") + 1), F.get("r", F.col("at"))
    fresh = b.isNull() | (b == ".")
    last = final.select("doc_id", "same", "kind", "marked", "ended", F.when(fresh | a.isNull() | (a == "."), "^").otherwise(a).alias("a"), F.when(fresh, "^").otherwise(b).alias("b"), F.get("r", F.col("at") - 1).alias("c"))
    return counts, last


def _with_counts(last: DataFrame, counts: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``last`` with counts inside, at ends and before stops summed by ``keys``; only runs that are some text's last are kept."""
    wanted = last.select(*keys).distinct()
    summed = counts.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.sum("inside").alias(f"i{name}"), F.sum("ends").alias(f"e{name}"), F.sum("stops").alias(f"s{name}"))
    return last.join(summed, keys, "left").fillna(0, [f"i{name}", f"e{name}", f"s{name}"])


def _longer(pieces: DataFrame, longer: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys, c, name, inside_name``: how often words stand in ``longer`` (``keys, longer, n, inside``), and how often inside, that begin with the piece ``c`` and go on.

    Pieces shorter than ``PREFIX`` meet the listed starts of longer words, all others their first ``PREFIX`` characters:
    no join is on a single hot word and none lists all starts of a very long one.
    """
    wanted = pieces.select(*keys, "c").distinct()
    if keys:
        longer = longer.join(wanted.select(*keys).distinct(), keys, "left_semi")
    starts = longer.withColumn("c", F.explode(F.expr(f"transform(sequence(1, greatest(least(length(longer) - 1, {PREFIX - 1}), 1)), k -> substring(longer, 1, k))"))).filter("length(c) < length(longer)")
    short = wanted.filter(F.length("c") < PREFIX).join(starts, [*keys, "c"]).select(*keys, "c", "n", "inside")
    head = F.substring("longer", 1, PREFIX).alias("head")
    long = wanted.filter(F.length("c") >= PREFIX).withColumn("head", F.substring("c", 1, PREFIX)).join(longer.filter(F.length("longer") > PREFIX).withColumn("head", head), [*keys, "head"])
    long = long.filter("length(longer) > length(c) AND startswith(longer, c)").select(*keys, "c", "n", "inside")
    return short.unionByName(long).groupBy(*keys, "c").agg(F.sum("n").alias(name), F.sum("inside").alias(f"inside_{name}"))


def judged(docs: DataFrame) -> DataFrame:
    """``doc_id, kind, a, b, c, marked, cut`` of every text with a word: its last trigram, and whether it was cut off."""
    counts, last = truncation_tables(docs)
    last = materialize(last, "last-trigrams")
    ends = last.filter("NOT ended").groupBy("kind", "a", "b", "c").agg(F.lit(0).cast("long").alias("inside"), F.countDistinct("same").alias("ends"), F.lit(0).cast("long").alias("stops"))
    counts = materialize(counts.unionByName(ends), "trigrams")
    open_ = last.filter("NOT ended")
    for keys, name in ((["kind", "a", "b", "c"], "3"), (["kind", "b", "c"], "2"), (["kind", "c"], "1"), (["a", "b", "c"], "3a"), (["b", "c"], "2a"), (["c"], "1a")):
        open_ = _with_counts(open_, counts, keys, name)
    kinds = counts.groupBy("kind").agg(F.sum("inside").alias("i0"), F.sum("ends").alias("e0"))
    open_ = materialize(open_.join(F.broadcast(kinds), "kind"), "ends")  # one row for each kind of line
    # longer words in the place of the last one: after the same two words, after the same word, and whatever stands before
    both = [F.sum(F.expr("inside + ends + stops")).alias("n"), F.sum(F.expr("inside + stops")).alias("inside")]
    triples = counts.groupBy("a", "b", F.col("c").alias("longer")).agg(*both)
    pairs = counts.groupBy("b", F.col("c").alias("longer")).agg(*both)
    singles = pairs.groupBy("longer").agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    after2 = _longer(open_.filter("i3a < e3a"), triples, ["a", "b"], "longer3")
    after = _longer(open_.filter("i2a < e2a"), pairs, ["b"], "longer2")
    anywhere = _longer(open_.filter("i1a = 0").filter(~F.col("c").rlike(_NUMBER)), singles, [], "longer1")
    open_ = open_.join(after2, ["a", "b", "c"], "left").join(after, ["b", "c"], "left").join(anywhere, "c", "left")
    open_ = open_.fillna(0, [f"{x}longer{n}" for x in ("", "inside_") for n in (3, 2, 1)])

    def share(name: str) -> Column:
        """Share of the other uses of the last words that are at an end, if there are enough."""
        i, e = F.col(f"i{name}"), F.col(f"e{name}") - 1
        return F.when(i + e >= ENOUGH, e / (i + e))

    by_words = F.coalesce(share("3"), share("2"), share("1"), F.col("e0") / F.greatest(F.col("i0") + F.col("e0"), F.lit(1)))
    # short lines end anywhere: only their own words, of whatever kind of line, say something
    by_words = F.when(F.col("kind") == "short", F.coalesce(share("3"), share("3a"), share("2a"))).otherwise(by_words)
    def chance(name: str) -> Column:
        """Whether ends are so rare among many uses, those before a stop included, that they are but cuts."""
        e = F.col(f"e{name}") - 1
        n = F.col(f"i{name}") + F.col(f"s{name}") + e
        return (n >= 1 / RARE_SHARE) & (e < RARE_SHARE * n)

    # what rare uses in this kind of line say yields to many uses
    prose = F.col("kind") == "prose"
    by_all = (F.col("kind").isin("prose", "short") & (chance("3a") | chance("2a"))) | (prose & (chance("3") | chance("2")))
    in_sentence = by_all | F.coalesce(by_words < END_SHARE, F.lit(False)) | (F.col("marked") & (F.col("kind") == "short"))

    def piece(name: str, most: Column, own: int = 0) -> Column:
        """The last word is found inside less than ``most`` times, and longer ones are far more frequent than its ends. ``own``: its own end counts too, for want of other evidence."""
        longer = F.col(f"longer{name}")
        return (F.col(f"i{name}a") < most) & (longer > 0) & (F.col(f"e{name}a") - 1 + own <= PIECE_SHARE * longer)

    def number(name: str) -> Column:
        """So does a number; outside prose only where longer ones hardly stand at ends, for such numbers may have any length."""
        e, longer, inside = F.col(f"e{name}a"), F.col(f"longer{name}"), F.col(f"inside_longer{name}")
        most = F.when(prose, PIECE_SHARE).otherwise(RARE_SHARE) * inside
        return (F.col(f"i{name}a") < e) & (e <= most) & (prose | (longer - inside <= most))

    in_word = F.when(F.col("c").rlike(_NUMBER), number("3") | number("2")).otherwise(piece("3", F.col("e3a"), 1) | piece("2", F.col("e2a")) | piece("1", F.lit(1)))
    flagged = open_.select("doc_id", "kind", "a", "b", "c", "marked", (in_sentence | in_word).alias("cut"))
    return flagged.unionByName(last.filter("ended").select("doc_id", "kind", "a", "b", "c", "marked", F.lit(False).alias("cut")))


def truncated(docs: DataFrame) -> DataFrame:
    """``doc_id`` of every text that was cut off. Null, blank and wordless texts aren't; repeated rows are judged each; an empty table gives no row; further columns are ignored."""
    return judged(docs).filter("cut").select("doc_id")


def truncation_rates(docs: DataFrame) -> DataFrame:
    """``source, n_docs, n_truncated, share``: how often each source truncates; null is a source of its own."""
    cut = truncated(docs).groupBy("doc_id").agg(F.lit(1).alias("_cut"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source").join(cut, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("n_docs"), F.count("_cut").alias("n_truncated")).withColumn("share", F.col("n_truncated") / F.col("n_docs"))
