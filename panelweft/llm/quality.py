"""Quality rules whose cutoffs are certified on labelled holdouts.

A rule rejects a text whose measure (a ratio of two counts) is above a cutoff.  The ladder of
each rule's cutoffs is fixed, from lenient to strict, so the labels choose nothing but how far
down it goes.  For every stratum, rule and cutoff the good holdouts that it rejects are
counted; the exact binomial tail P(Bin(n, alpha / rules) <= rejected) is the p-value of "the
rule rejects more than alpha / rules of the stratum's good texts".  A ladder is walked while
that p-value is at most delta / (strata * rules): within a ladder the hypotheses are tested in
a fixed order, so only the ladders need the correction (Bonferroni).  With a probability of
1 - delta at least, in every stratum all rules together reject at most alpha of good texts.

A stratum with too few good holdouts, or none, certifies nothing, and its texts are judged by
the base rule alone.  Null is a stratum of its own; strata are one, whatever they hold.

Everything is DataFrame functions: a text is read once, its counts are stored, and labels meet
the counts only.  Null and empty texts have no words and fail the base rule; equal texts of a
stratum have equal verdicts.  Rows that repeat an id are one holdout, rejected where one of
them is; an id with several labels is good where all of them are.  Rows without an id are no
holdouts.  Extra columns don't matter; an empty table gives no rows; texts are taken whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweft.llm import common as C

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of the windows whose repetition is measured.
WINDOW = 5
#: Strata whose cutoffs are sent to every task; more are joined by a shuffle.
MAX_BROADCAST_STRATA = 100_000


@dataclass(frozen=True)
class Rule:
    """Rejects where 1000 * over > cutoff * under; the ladder goes from lenient to strict."""

    name: str
    over: str
    under: str
    ladder: tuple[int, ...]


_SHARES = (900, 800, 700, 600, 500, 400, 300, 250, 200, 150, 100, 75, 50, 25, 10)
RULES = (
    Rule("symbols", "n_symbols", "word_chars", _SHARES),
    Rule("dup_lines", "n_dup_lines", "n_lines", _SHARES),
    Rule("repeats", "n_repeat_words", "n_words", _SHARES),
    Rule("capitals", "n_capitals", "word_chars", _SHARES),
    Rule("word_length", "word_chars", "n_words", (20000, 15000, 12000, 10000, 9000, 8500, 8000, 7500, 7000, 6500)),
)


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", strata: Sequence[str] = ("lang",)) -> DataFrame:
    """(id, stratum, counts): the counts that rules are made of, by one pass over whole texts.

    stratum: a struct of the columns strata; word_chars: code points in words; n_symbols,
    n_capitals: characters of SYMBOLS and of A-Z; n_lines: lines with a word, n_dup_lines: those
    equal to an earlier one; n_repeat_words: words in windows of WINDOW words that the text has
    twice or more.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    dropped = lambda chars: F.length(F.translate(text, chars, ""))
    one = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.struct(*[F.col(f"`{s}`") for s in strata]).alias("stratum"), F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda x: F.xxhash64(x)).alias("words"), F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)).alias("lines"),
        dropped(SPACE).cast("long").alias("word_chars"), (F.length(text) - dropped(SYMBOLS)).cast("long").alias("n_symbols"), (F.length(text) - dropped(CAPITALS)).cast("long").alias("n_capitals"),
    )
    two = one.select("id", "stratum", F.size("words").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_capitals", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _windows(F.col("words")).alias("windows"))
    return two.withColumn("n_repeat_words", _covered(F.col("windows"))).drop("windows")


def _windows(words: Column) -> Column:
    """Hashes of the windows of an array of word hashes."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    return F.when(F.size(words) >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: windows sorted with their places, neighbours compared, their cover summed."""

    def places(s: Column) -> Column:
        # s has one element, the sorted windows: a lambda's variable is computed once
        same = lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(x["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))

    placed = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    at = F.get(F.transform(F.array(F.sort_array(placed)), places), 0)
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    total = F.aggregate(at, zero, lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"])
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), total).otherwise(F.lit(0).cast("long"))


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rejects(rule: Rule, cutoff: Column) -> Column:
    return 1000 * F.col(rule.over) > cutoff * F.col(rule.under)


def _ln_factorial(n: Column) -> Column:
    """ln(n!) by Stirling's series, after a shift that makes it exact to some 1e-12."""
    z = n.cast("double") + 9  # n! = (n + 8)! / ((n + 1) ... (n + 8)), and (n + 8)! is the gamma function at n + 9
    series = (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    shift = F.lit(0.0)
    for k in range(1, 9):
        shift = shift + F.ln(n.cast("double") + k)
    return series - shift


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below n * p; 1 from there on, as no such count speaks against p.

    Terms more than 40 standard deviations below k are under 1e-300 of the last and add nothing.
    """
    first = F.greatest(F.lit(0).cast("long"), (k - 40 - F.ceil(40 * F.sqrt(n.cast("double") * p))).cast("long"))
    term = lambda j: F.exp(_ln_factorial(n) - _ln_factorial(j) - _ln_factorial(n - j) + j * math.log(p) + (n - j) * math.log(1 - p))
    return F.when(k < n * p, F.aggregate(F.sequence(first, k), F.lit(0.0), lambda a, j: a + term(j))).otherwise(F.lit(1.0))


def certify(counts: DataFrame, labels: DataFrame, *, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", label_col: str = "quality", alpha: float = 0.05, delta: float = 0.05) -> DataFrame:
    """(stratum, rule, n, cutoff, rejected, p_value): the strictest certified cutoff of each ladder that has one.

    counts: of measures(); labels: (id_col, label_col), 1 for good.
    """
    good = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("good")).filter("good = 1").select("id")
    # The rung at which a rule begins to reject a text: as many as let it pass.
    rung = lambda r: F.size(F.filter(F.array(*[F.lit(c) for c in r.ladder]), lambda c: ~rejects(r, c)))
    judged = counts.filter(F.col("id").isNotNull() & ~base_failed()).select("id", "stratum", *[rung(r).alias(f"r{i}") for i, r in enumerate(rules)])
    held = judged.join(good, "id", "left_semi").groupBy("id", "stratum").agg(*[F.min(f"r{i}").alias(f"r{i}") for i in range(len(rules))])
    rungs = F.explode(F.array(*[F.struct(F.lit(i).alias("rule"), F.col(f"r{i}").alias("rung")) for i in range(len(rules))]))
    tally = held.select("stratum", rungs.alias("x")).groupBy("stratum", "x.rule", "x.rung").agg(F.count("*").alias("m"))
    per = tally.groupBy("stratum", "rule").agg(F.sum("m").alias("n"), F.collect_list(F.struct("rung", "m")).alias("hit"))
    n_strata = per.select("stratum").distinct().agg(F.count("*").alias("strata"))
    of_rule = lambda values: F.element_at(F.array(*values), F.col("rule") + 1)
    steps = per.crossJoin(F.broadcast(n_strata)).select("stratum", "rule", "n", "hit", "strata", F.posexplode(of_rule([F.array(*[F.lit(c) for c in r.ladder]) for r in rules])).alias("step", "cutoff"))
    # A cutoff rejects the texts whose rung it has reached.
    steps = steps.withColumn("rejected", F.expr("aggregate(hit, 0L, (a, x) -> a + if(x.rung <= step, x.m, 0L))"))
    steps = steps.withColumn("p_value", binomial_tail(F.col("n"), F.col("rejected"), alpha / len(rules))).withColumn("fails", (F.col("p_value") > delta / (F.col("strata") * len(rules))).cast("int"))
    passed = steps.withColumn("broken", F.max("fails").over(Window.partitionBy("stratum", "rule").orderBy("step"))).filter("broken = 0")
    best = passed.groupBy("stratum", "rule").agg(F.max_by(F.struct("n", "cutoff", "rejected", "p_value"), "step").alias("x"))
    return best.select("stratum", of_rule([F.lit(r.name) for r in rules]).alias("rule"), "x.n", "x.cutoff", "x.rejected", "x.p_value")


def judge(counts: DataFrame, cutoffs: DataFrame, *, rules: Sequence[Rule] = RULES) -> DataFrame:
    """counts with base_failed, rejected_by (names of the rules, comma-joined) and kept."""
    wide = cutoffs.groupBy(F.col("stratum").alias("of")).agg(*[F.max(F.when(F.col("rule") == r.name, F.col("cutoff"))).alias(f"c{i}") for i, r in enumerate(rules)])
    small = wide.limit(MAX_BROADCAST_STRATA + 1).count() <= MAX_BROADCAST_STRATA
    met = counts.join(F.broadcast(wide) if small else wide, F.col("stratum").eqNullSafe(F.col("of")), "left")
    by = F.array_compact(F.array(*[F.when(rejects(r, F.col(f"c{i}")), F.lit(r.name)) for i, r in enumerate(rules)]))
    out = met.withColumn("base_failed", base_failed()).withColumn("rejected_by", F.array_join(by, ",")).withColumn("kept", ~F.col("base_failed") & (F.col("rejected_by") == ""))
    return out.drop("of", *[f"c{i}" for i in range(len(rules))])


def op13_quality(spark, sf_dir: str) -> DataFrame:
    """Counts and verdicts of every document, by cutoffs certified on all good labelled ones of its language."""
    path = C.shared_dir(spark)
    counts = C.stored(measures(C.table(spark, sf_dir, "documents")), f"{path}/counts")
    cutoffs = C.stored(certify(counts, C.table(spark, sf_dir, "labels").select("doc_id", "quality")), f"{path}/cutoffs")
    out = judge(counts, cutoffs)
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


_RULE_ROWS = ", ".join(f"({i}, {s}, {c})" for i, r in enumerate(RULES) for s, c in enumerate(r.ladder))
_RUNGS = ", ".join(f"({i}, {r.over}, {r.under})" for i, r in enumerate(RULES))
_NAMES = ", ".join(f"'{r.name}'" for r in RULES)
_P = 0.05 / len(RULES)
ORACLE = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
line AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM win) WHERE k > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT line.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(regexp_extract_all(t, '[A-Z]')) AS BIGINT) AS n_capitals,
 CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words FROM line LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
ladder(rule, step, cutoff) AS (VALUES {_RULE_ROWS}),
measure AS (SELECT doc_id, lang, base_failed, x.rule, x.o, x.u FROM (SELECT *, unnest([{", ".join(f"{{'rule': {i}, 'o': {r.over}, 'u': {r.under}}}" for i, r in enumerate(RULES))}]) AS x FROM b)),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
cell AS (SELECT lang, l.rule, step, cutoff, count(*) AS n, count(*) FILTER (1000 * o > cutoff * u) AS k FROM measure q JOIN good USING (doc_id) JOIN ladder l ON l.rule = q.rule WHERE NOT base_failed GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k < n * {_P!r} THEN list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_P!r}) + (n - j) * ln(1 - {_P!r})))) ELSE 1 END AS p FROM cell),
walk AS (SELECT *, max(CASE WHEN p > 0.05 / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM cell)) * {len(RULES)}) THEN 1 ELSE 0 END) OVER (PARTITION BY lang, rule ORDER BY step) AS broken FROM tail),
cut AS (SELECT lang, rule, min(cutoff) AS cutoff FROM walk WHERE broken = 0 GROUP BY lang, rule),
bad AS (SELECT doc_id, string_agg([{_NAMES}][q.rule + 1], ',' ORDER BY q.rule) AS rejected_by FROM measure q JOIN cut c ON c.lang IS NOT DISTINCT FROM q.lang AND c.rule = q.rule WHERE 1000 * o > cutoff * u GROUP BY doc_id)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.doc_id IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM b LEFT JOIN bad USING (doc_id)
"""
