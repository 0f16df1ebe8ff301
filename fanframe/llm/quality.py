"""Quality rules: base rules, and robust multivariate outliers per language and source.

Statistics come from array expressions over each text's words, so texts never leave their row.
For each (language, source) group a minimum-covariance-determinant estimate is fitted to four
transformed statistics, from several starts: the halves nearest to the medians by the sum of
squares, the sum and the maximum of the statistics' deviations, in units of their median deviations.
Each start is followed by concentration steps (keep the half
with the smallest Mahalanobis distance, take its mean and covariance), and the start that ends with the smallest
determinant gives the group's estimate. A small group's mean and covariance are drawn towards those
of its language, and a language's towards those of all rows, by PRIOR_ROWS rows' worth; the weight
fades with the group's rows, and no size is treated apart. The covariance is scaled until the
median distance is that of chi-square; documents beyond its 0.999 quantile are rejected.

Everything is DataFrame expressions; all aggregates combine before they shuffle. Estimates go
to the rows by a join on (language, source, salt), so a source with a third of all rows is
spread over the salts.

Defined results: null and empty texts have no words and fail the base rules; null languages
and sources are groups of their own; a group without rows that pass the base rules has none to judge;
ties at the concentration threshold all stay in; null and repeated ids do no harm, repeated rows are
judged alike; an empty table gives no rows; other columns than the text, language and source and those asked for are
never read.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanframe.llm.common import SPACES, WORD, discard, materialize, text_or_empty

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Fixed value: characters counted as symbols.
SYMBOLS = "#*$%&|<>"
PRIOR_ROWS = 20  # rows that the estimate of the language (or of all rows) weighs in a group's own
STARTS = 3
STEPS = 3
SALTS = 16
#: Chi-square with 4 degrees of freedom: the median, and the 0.999 quantile, beyond which a document is rejected.
CHI_MEDIAN, CUTOFF = 3.3567, 18.467
#: Least standard deviation of each feature: the noise of counting in a text of MIN_WORDS words.
#: Word lengths deviate by half their mean; roots and arcs of counts by 1/2; repeated words come in threes.
FLOORS = (0.5 / MIN_WORDS**0.5, 0.5 / MIN_WORDS**0.5, 0.5 / MIN_WORDS**0.5, 0.5 * (3 / MIN_WORDS) ** 0.5)
FEATURES = ("f_word_length", "f_symbols", "f_dup_lines", "f_repeats")
INDEX_BITS = 31


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in `keep` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = F.filter(F.split("t", SPACES + "+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD))
    a = docs.select(*keep, text_or_empty().alias("t")).select(
        *keep,
        words.alias("w"),
        lines.alias("l"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.char_length(F.regexp_replace("t", SPACES + "+", "")).cast("long").alias("word_chars"),
    )
    n = F.size("w")
    at = lambda i: F.get("w", i)
    # Windows as one long each: 32 bits of hash, then the position; sorted, equal hashes are neighbours.
    code = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.shiftleft(F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(F.lit(0xFFFFFFFF)), INDEX_BITS).bitwiseOR(i.cast("long")))
    b = a.select(
        *keep,
        "n_symbols",
        "word_chars",
        "w",
        n.cast("long").alias("n_words"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, code).otherwise(F.array().cast("array<long>")).alias("c"),
    )
    rest = [*keep, "n_symbols", "word_chars", "n_words", "n_dup_lines"]
    c = b.select(*rest, "w", F.sort_array("c").alias("s"))
    high = lambda x: F.shiftright(x, INDEX_BITS)
    shared = F.filter("s", lambda x, j: (high(x) == high(F.get("s", j - 1))) | (high(x) == high(F.get("s", j + 1))))
    d = c.select(*rest, "w", F.transform(shared, lambda x: x.bitwiseAND(F.lit((1 << INDEX_BITS) - 1)).cast("int")).alias("i"))
    # Equal hashes are candidates only: the words themselves decide.
    window = F.transform("i", lambda i: F.struct(F.concat_ws(" ", at(i), at(i + 1), at(i + 2)).alias("g"), i.alias("i")))
    e = d.select(*rest, F.when(F.size("i") > 0, F.array_sort(window)).otherwise(F.array().cast("array<struct<g:string,i:int>>")).alias("g"))
    same = F.filter("g", lambda x, j: (x["g"] == F.get("g", j - 1)["g"]) | (x["g"] == F.get("g", j + 1)["g"]))
    covered = F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return e.select(*rest, F.when(F.size("g") > 0, covered).otherwise(0).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return [
        F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))).alias(FEATURES[0]),
        F.sqrt(F.col("n_symbols") / n).alias(FEATURES[1]),
        F.sqrt(F.col("n_dup_lines") / n).alias(FEATURES[2]),
        F.asin(F.sqrt(F.col("n_repeat_words") / n)).alias(FEATURES[3]),
    ]


PAIRS = list(itertools.combinations_with_replacement(range(len(FEATURES)), 2))


#: Of estimates; those of groups have no start.
KEYS = ("lang", "source", "start")
MEANS = [f"m{i}" for i in range(4)]
COVARIANCE = [f"c{i}{j}" for i, j in PAIRS]
FACTOR = [f"l{i}{j}" for i in range(4) for j in range(i + 1)]


def _factored(g: DataFrame) -> DataFrame:
    """Adds the Cholesky factor of the covariance with floors on its diagonal."""
    for j in range(4):  # a column of the factor after the other
        left = F.greatest(F.col(f"c{j}{j}"), F.lit(0.0)) + FLOORS[j] ** 2 - sum((F.col(f"l{j}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
        g = g.withColumn(f"l{j}{j}", F.sqrt(F.greatest(left, F.lit(FLOORS[j] ** 2 / 4))))
        for i in range(j + 1, 4):
            g = g.withColumn(f"l{i}{j}", (F.col(f"c{j}{i}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}"))
    return g


def _inner_estimates(inner: DataFrame, priors: DataFrame | None) -> DataFrame:
    """Mean, covariance and factor of each group's rows, drawn towards the prior."""
    sums = [F.sum(f).alias(f"s{i}") for i, f in enumerate(FEATURES)]
    products = [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}{j}") for i, j in PAIRS]
    g = inner.groupBy(*KEYS).agg(F.count("*").alias("n"), *sums, *products)
    if priors is None:
        mean = {f"m{i}": F.col(f"s{i}") / F.col("n") for i in range(4)}
        square = {f"c{i}{j}": F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in PAIRS}
    else:
        g, w, prior = _with_prior(g, priors), float(PRIOR_ROWS), lambda c: F.col(f"prior_{c}")
        mean = {f"m{i}": (F.col(f"s{i}") + w * prior(f"m{i}")) / (F.col("n") + w) for i in range(4)}
        square = {f"c{i}{j}": (F.col(f"p{i}{j}") + w * (prior(f"c{i}{j}") + prior(f"m{i}") * prior(f"m{j}"))) / (F.col("n") + w) - F.col(f"m{i}") * F.col(f"m{j}") for i, j in PAIRS}
    return _factored(g.withColumns(mean).withColumns(square)).select(*KEYS, *MEANS, *COVARIANCE, *FACTOR)


def _with_prior(g: DataFrame, priors: DataFrame) -> DataFrame:
    """Groups with the columns of their prior, as prior_*: that of their language, or that of all rows."""
    wider = [c for c in ("lang", "source") if c in priors.columns]
    p = priors.withColumnsRenamed({c: f"prior_{c}" for c in priors.columns})
    on = F.lit(True)
    for c in wider:
        on = on & F.col(c).eqNullSafe(F.col(f"prior_{c}"))
    return g.join(p, on, "left").drop(*[f"prior_{c}" for c in wider])


def _with_estimate(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Rows with their group's estimate: the small side is repeated once for each salt of the rows."""
    keys = [c for c in KEYS if c in estimate.columns]
    small = estimate.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnsRenamed({c: f"g_{c}" for c in [*keys, "salt"]})
    on = F.col("salt") == F.col("g_salt")
    for c in keys:
        on = on & F.col(c).eqNullSafe(F.col(f"g_{c}"))
    return rows.join(small, on, "left").drop(*[f"g_{c}" for c in [*keys, "salt"]])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution (null without an estimate)."""
    z: list[Column] = []
    for i in range(4):
        z.append((F.col(FEATURES[i]) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * z[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((x * x for x in z[1:]), z[0] * z[0])


def _median(column: str) -> Column:
    return F.percentile_approx(column, 0.5, 1000)


def _started(rows: DataFrame) -> DataFrame:
    """Rows once for each start, with `far` from the medians and median deviations of their group."""
    mid = materialize(rows.groupBy("lang", "source").agg(*[_median(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]), "medians")
    off = _with_estimate(rows, mid).select("lang", "source", *[F.abs(F.col(f) - F.col(f"m{i}")).alias(f"d{i}") for i, f in enumerate(FEATURES)])
    off = off.groupBy("lang", "source").agg(*[_median(f"d{i}").alias(f"d{i}") for i in range(4)])
    both = mid.alias("a").join(off.alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.lang", "a.source", *MEANS, *[f"d{i}" for i in range(4)])
    z = [F.abs(F.col(f) - F.col(f"m{i}")) / F.greatest(1.4826 * F.col(f"d{i}"), F.lit(FLOORS[i])) for i, f in enumerate(FEATURES)]
    far = [sum((x * x for x in z[1:]), z[0] * z[0]), sum(z[1:], z[0]), F.greatest(*z)]
    out = _with_estimate(rows, both).select(*rows.columns, F.posexplode(F.array(*far)).alias("start", "far"))
    out = materialize(out, "started")
    discard(mid)
    return out


def _fitted(rows: DataFrame, priors: DataFrame | None) -> DataFrame:
    """A table of minimum-covariance-determinant estimates of all groups (lang, source): MEANS, COVARIANCE, FACTOR and log_scale."""
    started = _started(rows)
    placed, estimates, used = started, None, [started]
    for k in range(STEPS):
        if k:
            placed = _with_estimate(started.drop("far"), estimates).withColumn("far", _distance()).select(*started.columns)
        halves = placed.groupBy(*KEYS).agg(_median("far").alias("half"))
        estimates = materialize(_inner_estimates(_with_estimate(placed, halves).filter("far <= half"), priors), f"mcd {k}")
        used.append(estimates)
    # The start with the smallest determinant, ties to the first.
    size = sum((F.log(f"l{i}{i}") for i in range(1, 4)), F.log("l00"))
    best = estimates.groupBy("lang", "source").agg(F.min(F.struct(size.alias("det"), "start")).alias("x")).select("lang", "source", "x.start").withColumnsRenamed({"lang": "b_lang", "source": "b_source", "start": "b_start"})
    best = estimates.join(best, F.col("lang").eqNullSafe(F.col("b_lang")) & F.col("source").eqNullSafe(F.col("b_source")) & (F.col("start") == F.col("b_start"))).select("lang", "source", *MEANS, *COVARIANCE, *FACTOR)
    best = materialize(best, "best starts")
    # The covariance of the inner half is too small: it is scaled until the median distance is that of chi-square.
    middle = _with_estimate(rows, best).withColumn("far", _distance()).groupBy("lang", "source").agg(_median("far").alias("half"), F.count("*").alias("rows"))
    middle = middle.select(F.col("lang").alias("x_lang"), F.col("source").alias("x_source"), "half", "rows")
    all_of = best.join(middle, F.col("lang").eqNullSafe(F.col("x_lang")) & F.col("source").eqNullSafe(F.col("x_source")))
    own = F.log(F.greatest(F.col("half") / CHI_MEDIAN, F.lit(1.0)))
    if priors is not None:
        all_of = _with_prior(all_of, priors)
        own = (F.col("rows") * own + PRIOR_ROWS * F.col("prior_log_scale")) / (F.col("rows") + PRIOR_ROWS)
    out = materialize(all_of.select("lang", "source", *MEANS, *COVARIANCE, *FACTOR, own.alias("log_scale")), "estimates")
    for table in [*used, best]:
        discard(table)
    return out


def fit(rows: DataFrame) -> DataFrame:
    """The scaled estimate of each group (lang, source) of the rows, drawn towards its language's, and that towards the one of all rows."""
    none = F.lit(None).cast("string")
    of_all = _fitted(rows.withColumn("lang", none).withColumn("source", none), None)
    of_lang = _fitted(rows.withColumn("source", none), of_all.drop("lang", "source"))
    own = _fitted(rows, of_lang.drop("source"))
    return own.select("lang", "source", *MEANS, *[(F.col(c) * F.exp(F.col("log_scale") / 2)).alias(c) for c in FACTOR])


def judge(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns in `keep`, the statistics, base_failed and kept, one row per document."""
    inputs = list(dict.fromkeys([*keep, "lang", "source"]))
    named = docs.select(*[F.col(c).alias(f"k_{c}") for c in inputs], "text")
    rows = statistics(named, [f"k_{c}" for c in inputs])
    rows = rows.withColumnsRenamed({"k_lang": "lang", "k_source": "source"})
    rows = rows.select("*", base_failed().alias("base_failed"), *features(), F.pmod(F.xxhash64(*[f"k_{c}" for c in inputs if c not in ("lang", "source")], "word_chars", "n_words"), F.lit(SALTS)).cast("int").alias("salt"))
    rows = materialize(rows, "quality statistics")
    good = materialize(rows.filter(~F.col("base_failed")).select("lang", "source", "salt", *FEATURES), "good statistics")
    far = _with_estimate(rows, fit(good)).withColumn("far", _distance())
    kept = ~F.col("base_failed") & (F.coalesce("far", F.lit(0.0)) <= CUTOFF)
    own = [F.col(f"k_{c}" if c not in ("lang", "source") else c).alias(c) for c in keep]
    return far.select(*own, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.col("far").alias("distance"))


def digest_quality(docs: DataFrame) -> DataFrame:
    return judge(docs, ["doc_id"])
