"""Operator 1: quality rules with robust multivariate outliers, in DataFrame functions only.

Each text gives a vector of five transformed statistics that vary in ordinary prose: mean word length, punctuation per word, sentence ends
per word, the share of different words in each SEGMENT words in a row (logarithms), and the share of words of up to three characters (root).
All are shrunken by PSEUDO words of the language's average, so that a vector's spread hardly depends on the
length of the text; nor does its centre, as segments have one length. Every pair of language and source, whatever its size, gets its own
minimum-covariance-determinant estimate of their location and scatter:

* C-steps: take the part H of the documents with the smallest distances, (n + 5 + 1) / 2 of them (and those in the
  same fine bin of distance as the last), estimate anew from them, repeat until the determinant falls no more; of two
  deterministic starts (all documents; all documents weighed by how near they are) the one with the smaller determinant wins.
* The scatter of H is made consistent (a factor of its share of the group), and the estimate is taken anew from the
  documents within the 0.975 chi-square quantile of it.
* It is pulled towards the same estimate of its language: n documents of the group weigh against PRIOR of the
  language, by one formula at every n. FLOOR, small beside any scatter measured, is added to the variances so that constant statistics can be divided by.

A document goes if its squared Mahalanobis distance exceeds the chi-square quantile that one normal document in 10**12 exceeds: a corpus of
100 TB has fewer. Nothing but these estimates decides beside the base rule.

A C-step is one aggregation: documents are grouped by group, start and a fine bin of the
distance, with counts, sums and products, so that H is a running sum over bins. No step holds a
group's rows together, whatever its size, and groups that have converged leave the next steps.

Defined cases: a null or blank text has no words and fails the base rule; null languages and
sources are groups of their own; documents that fail the base rule are in no estimate; equal
texts of one group get one verdict; a text of any length is one vector; every row of `docs` gives one row, repeats
included; an empty table gives none. Columns of `docs` beside doc_id, text, lang, source and keys named
`__k...` are left out, so their names can't clash.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table, text_column, tidied

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Documents of the language that are added, by weight, to a group's own.
PRIOR = 200
#: Words in a row of which different ones are counted; what is left behind the last segment is not.
SEGMENT = 20
#: Words of the language's average that are added to a text's own.
PSEUDO = 100
#: Standard deviation added to each statistic's own.
FLOOR = 1e-3
P = 5
#: Chi-square quantiles with five degrees of freedom: for the estimate taken anew (0.975), and for rejecting (1 - 10**-12).
CHI2_INNER, CHI2_LIMIT = 12.833, 65.239
#: A determinant that falls by less, in logarithms, has converged.
FALLS = 1e-6
_X = [f"x{i}" for i in range(P)]
_BLANKS = " \t\n\x0b\x0c\r"


def _chi2(x: float, k: int) -> float:
    """The share of a chi-square law with k (odd) degrees of freedom that lies below x."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for j in range(1, k, 2):
        total, term = total - term, term * x / (j + 2)
    return total


def consistency(percent: int) -> float:
    """What the scatter of the nearest `percent` of a normal sample is multiplied by to be that of the whole."""
    share, low, high = percent / 100, 0.0, 400.0
    if percent >= 100:
        return 1.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _chi2(middle, P) < share else (low, middle)
    return share / _chi2(low, P + 2)


def counts(docs: DataFrame) -> DataFrame:
    """`docs` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_marks, n_ends, n_short and n_different."""
    text = F.coalesce(text_column(docs), F.lit(""))
    trimmed = F.btrim(text, F.lit(_BLANKS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)) != "")
    rows = docs.select(
        *docs.columns,
        words.alias("__words"),
        lines.alias("__lines"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit(r"[.!?\n]+")).cast("long").alias("n_ends"),
    )
    rows = rows.select(
        *docs.columns, "n_symbols", "n_marks", "n_ends",
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("__words", lambda w: F.length(w) <= 3)).cast("long").alias("n_short"),
        F.when(F.size("__words") >= SEGMENT, F.aggregate(F.sequence(F.lit(0), F.floor(F.size("__words") / SEGMENT).cast("int") - 1), F.lit(0).cast("long"), lambda t, i: t + F.size(F.array_distinct(F.slice("__words", i * SEGMENT + 1, F.lit(SEGMENT)))))).otherwise(F.lit(0).cast("long")).alias("n_different"),
        F.when(F.size("__words") > WINDOW, F.transform("__words", lambda w: F.xxhash64(w))).alias("__h"),
    )
    reach = 1
    while reach < WINDOW:  # the hash of 2, 4, 8 words from those of half as many
        left = F.slice("__h", F.lit(1), F.size("__h") - reach)
        right = F.slice("__h", F.lit(1 + reach), F.size("__h") - reach)
        rows = rows.withColumn("__h", F.zip_with(left, right, lambda a, b: F.xxhash64(a, b)))
        reach *= 2
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    placed = F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("__s", F.when(again, F.sort_array(placed)))
    twice = F.filter("__s", lambda x, i: F.coalesce(x["h"] == F.get("__s", i + 1)["h"], F.lit(False)) | F.coalesce((i > 0) & (x["h"] == F.get("__s", i - 1)["h"]), F.lit(False)))
    rows = rows.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    new = F.transform("__at", lambda v, k: F.coalesce(F.least(F.lit(WINDOW), F.get("__at", k + 1) - v), F.lit(WINDOW)))
    repeated = F.coalesce(F.aggregate(new, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return rows.withColumn("n_repeat_words", repeated).drop("__h", "__s", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def with_vectors(rows: DataFrame) -> DataFrame:
    """Adds the statistics x0 to x4."""
    n = F.col("n_words")
    of = {"word_chars": n, "n_marks": n, "n_ends": n, "n_different": n - n % SEGMENT, "n_short": n}
    usual = rows.where("NOT base_failed").groupBy(F.col("lang").alias("__l")).agg(*((F.sum(c) / F.sum(words)).alias(f"__u_{c}") for c, words in of.items()))
    few = usual.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(usual) if few else usual, F.col("lang").eqNullSafe(F.col("__l")), "left")
    share = {c: (F.col(c) + PSEUDO * F.col(f"__u_{c}")) / (words + PSEUDO) for c, words in of.items()}
    # a statistic that no document of the language has is 0 for all
    log = lambda c: F.log(F.greatest(share[c], F.lit(1e-6)))
    x = (log("word_chars"), log("n_marks"), log("n_ends"), log("n_different"), F.sqrt(share["n_short"]))
    return joined.select(*rows.columns, *(F.coalesce(v.cast("double"), F.lit(0.0)).alias(c) for v, c in zip(x, _X)))


_M = [f"m{i}" for i in range(P)]
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_W = [f"w{i}{j}" for i, j in _PAIRS]
_C = [f"c{i}{j}" for i, j in _PAIRS]
_SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in _PAIRS)]


# The expressions of a step are SQL text, parsed at once: built as columns they are thousands of calls a step.
def _sums(weight: str = "1") -> list[Column]:
    return [F.expr(f"sum({weight})").alias("n"), *(F.expr(f"sum({weight} * x{i})").alias(f"s{i}") for i in range(P)), *(F.expr(f"sum({weight} * x{i} * x{j})").alias(f"q{i}{j}") for i, j in _PAIRS)]


def _moments(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Location m* and scatter c*, from n, s* and q*."""
    return sums.selectExpr(*keys, "n", *(f"s{i} / n AS m{i}" for i in range(P)), *(f"q{i}{j} / n - m{i} * m{j} AS c{i}{j}" for i, j in _PAIRS))


def _cholesky() -> list[str]:
    """l*, the Cholesky factor of the scatter with its floor, and w*, its inverse; each refers to those before it."""
    less = lambda i, j: "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
    out = []
    for j in range(P):
        out.append(f"sqrt(greatest(c{j}{j} + {FLOOR**2!r}D{less(j, j)}, 1e-12D)) AS l{j}{j}")
        out += [f"(c{i}{j}{less(i, j)}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, P)]
    out += [f"1 / l{i}{i} AS w{i}{i}" for i in range(P)]
    for gap in range(1, P):
        out += [f"-({' + '.join(f'l{i}{k} * w{k}{i - gap}' for k in range(i - gap, i))}) / l{i}{i} AS w{i}{i - gap}" for i in range(gap, P)]
    return out


def _factored(df: DataFrame) -> DataFrame:
    """Adds w*, the inverse Cholesky factor of the scatter with its floor, and log_det, the logarithm of its determinant."""
    det = "2 * (" + " + ".join(f"ln(l{i}{i})" for i in range(P)) + ") AS log_det"
    return df.selectExpr("*", *_cholesky(), det).select(*df.columns, *_W, "log_det")


def squared_distance() -> Column:
    rows = ("(" + " + ".join(f"w{i}{j} * (x{j} - m{j})" for j in range(i + 1)) + ")" for i in range(P))
    return F.expr(" + ".join(f"{row} * {row}" for row in rows))


def _bin() -> Column:
    """A fine bin of the squared distance: widths grow with it, below 2 % of it."""
    return F.floor(64 * F.log2(1 + 16 * squared_distance())).cast("int")


def _nearest(met: DataFrame) -> DataFrame:
    """Sums of the half H of every group and start, by whole bins of the distance; `share` is its percentage of the group."""
    upto = Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("group", "start")
    binned = met.withColumn("bin", _bin()).groupBy("group", "start", "bin").agg(F.first("log_det").alias("before_det"), *_sums())
    placed = binned.withColumns({"before": F.coalesce(F.sum("n").over(upto), F.lit(0)), "all": F.sum("n").over(every)})
    half = placed.where(F.col("before") < F.least(F.col("all"), F.floor((F.col("all") + P + 1) / 2)))
    share = F.greatest(F.lit(50), F.round(100 * F.sum("n") / F.first("all"))).cast("int").alias("share")
    return half.groupBy("group", "start").agg(F.first("before_det").alias("before_det"), share, *(F.sum(c).alias(c) for c in _SUMS))


@tidied("mcd")
def mcd(fit: DataFrame) -> DataFrame:
    """The MCD estimate of every group of `fit` (columns group, x0 to x4): group, share, n (of H), m*, c* (of H, as it is), w*, log_det."""
    start = lambda sums, k: _factored(_moments(sums, ["group"])).select("group", F.lit(k).alias("start"), *_M, *_W, F.lit(math.inf).alias("log_det"))
    whole = materialize(start(fit.groupBy("group").agg(*_sums()), 0), "mcd")
    weighed = _met(fit, whole).withColumn("w", 1 / (1 + squared_distance() / P)).groupBy("group").agg(*_sums("w"))
    now = materialize(whole.unionByName(start(weighed, 1)), "mcd")
    steps = []
    while True:  # every step lowers a determinant, or is the last
        sums = _nearest(_met(fit, now))
        found = _factored(_moments(sums, ["group", "start", "share", "before_det"])).withColumn("falls", F.col("log_det") < F.col("before_det") - FALLS)
        steps.append(materialize(found, "mcd"))
        now = steps[-1].where("falls").select("group", "start", *_M, *_W, "log_det")
        if now.isEmpty():
            break
    every = reduce(DataFrame.unionByName, steps)
    best = every.groupBy("group").agg(F.min_by(F.struct("share", "n", *_M, *_C, *_W, "log_det"), F.struct("log_det", "start")).alias("best"))
    return best.select("group", "best.*")


def reweighted(fit: DataFrame, raw: DataFrame) -> DataFrame:
    """group, n, m*, c* of the documents near the MCD estimate with its scatter made consistent."""
    factors = F.array(*(F.lit(consistency(percent)) for percent in range(50, 101)))
    wide = raw.select("group", *_M, *((F.col(c) * F.element_at(factors, F.col("share") - 49)).alias(c) for c in _C))
    near = _met(fit, materialize(_factored(wide).select("group", *_M, *_W), "near")).where(squared_distance() <= CHI2_INNER)
    return _moments(near.groupBy("group").agg(*_sums()), ["group"])


@tidied("estimates")
def estimates(fit: DataFrame, groups: DataFrame) -> DataFrame:
    """group, m* and w* of every `fine` group, pulled towards that of its `coarse` one. `fit` has the rows of both."""
    found = materialize(reweighted(fit, mcd(fit)), "estimates")
    wider = found.select(F.col("group").alias("coarse"), *(F.col(c).alias(f"{c}_") for c in (*_M, *_C)))
    few = found.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    own = found.withColumnRenamed("group", "fine").join(groups.select("fine", "coarse"), "fine")
    both = own.join(F.broadcast(wider) if few else wider, "coarse")
    pulled = both.select(F.col("fine").alias("group"), *(((F.col("n") * F.col(c) + PRIOR * F.col(f"{c}_")) / (F.col("n") + PRIOR)).alias(c) for c in (*_M, *_C)))
    return _factored(pulled).select("group", *_M, *_W)


#: Up to so many groups their estimates are broadcast (a few hundred bytes each); above, the join shuffles.
BROADCAST_GROUPS = 20_000


def _met(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    few = estimates.select("group").limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    return rows.join(F.broadcast(estimates) if few else estimates, "group", how)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and keys (`__k...`) of `docs`, with the counts, base_failed, kept and distance.

    `distance` is the squared Mahalanobis distance from the estimate of the row's language and source; it is null
    where all of these fail the base rule.
    """
    docs = docs.select(*(c for c in docs.columns if c in ("doc_id", "lang", "source", "text") or c.startswith("__k")))
    held = docs.columns
    rows = materialize(counts(docs).drop("text").withColumn("base_failed", base_failed()), "counts")
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    levels = with_vectors(rows).withColumns({"fine": F.to_json(F.array(text("lang"), text("source"))), "coarse": F.to_json(F.array(text("lang")))})
    levels = materialize(levels, "vectors")
    passed = levels.where("NOT base_failed")
    groups = passed.select("fine", "coarse").distinct()
    fit = materialize(passed.select(F.explode(F.array("fine", "coarse")).alias("group"), *_X), "fit")
    met = _met(levels.withColumnRenamed("fine", "group"), estimates(fit, groups), "left")
    return met.select(
        *(c for c in held if c != "text"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(squared_distance() > CHI2_LIMIT, F.lit(False))).alias("kept"), squared_distance().alias("distance"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that the quality rules keep, with its columns, whatever their names.

    Verdicts depend on language, source and text alone, so they are joined back by those.
    """
    text = text_column(docs)
    keys = {"__k0": F.col("lang"), "__k1": F.col("source"), "__k2": F.xxhash64(text), "__k3": F.xxhash64(text, F.lit(1))}
    own = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)), *(v.alias(k) for k, v in keys.items()))
    judged = quality(docs.select("lang", "source", "text", keys["__k2"].alias("__k2"), keys["__k3"].alias("__k3")))
    good = judged.where("kept").select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("__k2").alias("a"), F.col("__k3").alias("b")).distinct()
    on = own["__k0"].eqNullSafe(good["l"]) & own["__k1"].eqNullSafe(good["s"]) & (own["__k2"] == good["a"]) & (own["__k3"] == good["b"])
    return own.join(good, on, "left_semi").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("lang", "source")
