"""Quality rules by robust multivariate outliers.

Each text's statistics become a vector (logarithms, roots) in which ordinary
texts of one language and source lie in one ellipsoid.  Its centre and shape are
minimum-covariance-determinant estimates: from several starts, concentration steps
fit mean and covariance to the SHARE of the rows nearest to the last fit until no
determinant falls any more, and each group keeps the fit of the least determinant.
A text is rejected if its Mahalanobis distance is beyond a chi-square quantile.

All of it is SQL functions: vectors and matrices are columns, and a fit is one
grouped aggregate.  The share of nearest rows comes from a histogram of the
distances, so that no group is gathered or sorted and a group with a third of all
rows costs no more than others.

Defined results: a null text has no words and fails the base rules; texts are read
whole, whatever their length; only rows of ten words or more are fitted to and
counted for a group's size; rows with a null language or source form groups of
their own; groups with fewer than FEWEST such rows share the fit of their
language's other small groups, or of all such; with too few rows even there nothing
is rejected beyond the base rules; repeated rows count as often as they occur, and
rows at equal distances are fitted to together; an empty table gives no rows; other
columns are not carried, so names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from collonade.llm.common import checkpoint, join_sized, keep
from collonade.llm.statistics import with_statistics

#: Share of rows that a fit rests on, and fewest rows for a fit of their own.
SHARE, FEWEST = 0.75, 60
# Fixed values for five statistics: the chi-square quantile at 0.99999, and how much larger the covariance of a normal sample is than that of its nearest 75 %.
CUTOFF, CONSISTENT = 30.856, 1.47
#: A determinant falls if its logarithm does by this much.
SETTLED = 1e-3
#: Standard deviations below which no statistic's estimate falls, so that a statistic that is zero for most rows doesn't reject every other.
FLOORS = {"v_words": 0.9, "v_length": 0.12, "v_symbols": 0.5, "v_lines": 0.15, "v_repeats": 0.15}
BINS = 64
#: Words that a text needs to be fitted to.
SOUND = 10


def vectors(stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return stats.withColumns({
        "v_words": F.log1p("n_words"),
        "v_length": F.log(F.greatest(F.col("word_chars") / n, F.lit(0.1))),
        "v_symbols": F.log1p(F.col("n_symbols") * 100.0 / n),
        "v_lines": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "v_repeats": F.sqrt(F.col("n_repeat_words") / n),
    })


def scopes(rows: DataFrame, lang: str, source: str) -> DataFrame:
    """Add scope: language and source where they have FEWEST sound rows, else the language's small groups, else all small ones."""
    own = F.concat_ws("\x1f", F.coalesce(F.col(lang), F.lit("\x00")), F.coalesce(F.col(source), F.lit("\x00")))
    rows = rows.withColumn("_own", own)
    groups = rows.groupBy("_own").agg(F.count(F.when(F.col("n_words") >= SOUND, 1)).alias("_n"), F.first(F.coalesce(F.col(lang), F.lit("\x00"))).alias("_lang"))
    by_lang = F.sum(F.when(F.col("_n") < FEWEST, F.col("_n"))).over(Window.partitionBy("_lang"))
    scope = F.when(F.col("_n") >= FEWEST, F.col("_own")).when(by_lang >= FEWEST, F.concat(F.lit("\x1e"), F.col("_lang"))).otherwise(F.lit("\x1d"))
    return join_sized(rows, checkpoint(groups.select("_own", scope.alias("scope"))), "_own").drop("_own")


def moments(rows: DataFrame, names: list[str]) -> DataFrame:
    """For each scope n, the means m_i and the covariances c_i_j (i >= j), floored on the diagonal."""
    sums = [F.count("*").alias("n")]
    for i, a in enumerate(names):
        sums.append(F.sum(a).alias(f"s_{i}"))
        sums += [F.sum(F.col(a) * F.col(b)).alias(f"q_{i}_{j}") for j, b in enumerate(names[: i + 1])]
    out = rows.groupBy("scope").agg(*sums)
    cols = [F.col("scope"), F.col("n"), *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(len(names))]]
    for i in range(len(names)):
        for j in range(i + 1):
            c = F.col(f"q_{i}_{j}") / F.col("n") - F.col(f"s_{i}") / F.col("n") * F.col(f"s_{j}") / F.col("n")
            cols.append((F.greatest(c, F.lit(0.0)) if i == j else c).alias(f"c_{i}_{j}"))
    return out.select(*cols)


def whitening(fit: DataFrame, names: list[str], scale: float) -> DataFrame:
    """(scope, n, m_i, l_i_j, logdet): the Cholesky factor of the covariance, times scale and plus what the floors add, and the logarithm of its determinant."""
    p = len(names)
    for i in range(p):
        new = {}
        for j in range(i):
            dot = sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            new[f"l_{i}_{j}"] = (F.col(f"c_{i}_{j}") * scale - dot) / F.col(f"l_{j}_{j}")
            fit = fit.withColumns(new)
            new = {}
        left = F.col(f"c_{i}_{i}") * scale - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{i}_{k}") for k in range(i)), F.lit(0.0))
        floor = FLOORS[names[i]] ** 2
        fit = fit.withColumn(f"l_{i}_{i}", F.sqrt(F.greatest(left, F.lit(0.0)) + floor))
    logdet = sum((F.log(f"l_{i}_{i}") for i in range(p)), F.lit(0.0))
    return fit.select("scope", "n", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)], logdet.alias("logdet"))


def distances(rows: DataFrame, fit: DataFrame, names: list[str]) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, by forward substitution with the factor."""
    out = join_sized(rows, fit, "scope", "left")
    for i, a in enumerate(names):
        rest = sum((F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)), F.lit(0.0))
        out = out.withColumn(f"y_{i}", (F.col(a) - F.col(f"m_{i}") - rest) / F.col(f"l_{i}_{i}"))
    return out.withColumn("d2", sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(len(names))), F.lit(0.0)))


def nearest(rows: DataFrame, share: float) -> DataFrame:
    """Rows up to the histogram bin of log distance that completes the share in their scope."""
    bin_of: Column = F.floor(F.log(F.greatest(F.col("d2"), F.lit(1e-6))) * BINS).cast("int")
    rows = rows.withColumn("bin", bin_of)
    counts = rows.groupBy("scope", "bin").agg(F.count("*").alias("k"))
    up, whole = Window.partitionBy("scope").orderBy("bin"), Window.partitionBy("scope")
    filled = counts.select("scope", "bin", F.sum("k").over(up).alias("below"), F.sum("k").over(whole).alias("total"))
    limits = checkpoint(filled.where(F.col("below") >= F.col("total") * share).groupBy("scope").agg(F.min("bin").alias("last")))
    return join_sized(rows, limits, "scope").where("bin <= last")


#: Between a scope's name and a start's number, of one digit.
SEPARATOR, STARTS = "\x1c", 3


def starts(rows: DataFrame, names: list[str]) -> DataFrame:
    """(scope, n, m_i, c_i_j) of each start, scope being the scope's name, a separator and the start's.

    Medians with quartile ranges, which outliers under a quarter of the rows don't move (of a mergeable sketch); the
    same medians with the covariance of squashed deviations; and plain means and covariances.
    """
    p = len(names)
    quartiles = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    middle = rows.groupBy("scope").agg(F.count("*").alias("n"), *[F.percentile_approx(a, quartiles, 10_000).alias(f"p_{i}") for i, a in enumerate(names)])
    spread = [F.greatest((F.col(f"p_{i}")[2] - F.col(f"p_{i}")[0]) / 1.349, F.lit(FLOORS[a])).alias(f"s_{i}") for i, a in enumerate(names)]
    middle = checkpoint(middle.select("scope", "n", *[F.col(f"p_{i}")[1].alias(f"e_{i}") for i in range(p)], *spread))
    lower = [(i, j) for i in range(p) for j in range(i + 1)]
    columns = ["n", *[f"m_{i}" for i in range(p)], *[f"c_{i}_{j}" for i, j in lower]]
    medians = [F.col(f"e_{i}").alias(f"m_{i}") for i in range(p)]
    one = middle.select("scope", "n", *medians, *[(F.pow(f"s_{i}", F.lit(2)) if i == j else F.lit(0.0)).alias(f"c_{i}_{j}") for i, j in lower])
    squashed = join_sized(rows, middle.drop("n"), "scope").select("scope", *[F.tanh((F.col(a) - F.col(f"e_{i}")) / F.col(f"s_{i}")).alias(a) for i, a in enumerate(names)])
    two = moments(squashed, names).select("scope", *[f"c_{i}_{j}" for i, j in lower]).join(middle, "scope")
    two = two.select("scope", "n", *medians, *[(F.col(f"c_{i}_{j}") * F.col(f"s_{i}") * F.col(f"s_{j}")).alias(f"c_{i}_{j}") for i, j in lower])
    three = moments(rows, names)
    named = [df.select(F.concat("scope", F.lit(f"{SEPARATOR}{k}")).alias("scope"), *columns) for k, df in enumerate((one, two, three))]
    return checkpoint(named[0].union(named[1]).union(named[2]))


def fit(rows: DataFrame, names: list[str], share: float = SHARE) -> DataFrame:
    """Minimum-covariance-determinant estimates by scope, as means and Cholesky factors."""
    rows = rows.select("scope", *names)
    raw = starts(rows, names)
    spread = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(STARTS - 1)))).withColumn("scope", F.concat("scope", F.lit(SEPARATOR), F.col("_k"))).drop("_k")
    now, best = checkpoint(whitening(raw, names, 1.0)), None
    while True:
        raw = checkpoint(moments(nearest(distances(spread, now, names), share).select("scope", *names), names))
        now = checkpoint(whitening(raw, names, 1.0))
        new = raw.join(now.select("scope", "logdet"), "scope").select("scope", F.struct("logdet", *[c for c in raw.columns if c != "scope"]).alias("fit"))
        if best is None:
            best, fallen = checkpoint(new), 1
        else:
            both = new.join(best.withColumnRenamed("fit", "old"), "scope")
            falls = F.col("fit.logdet") < F.col("old.logdet") - SETTLED
            best = checkpoint(both.select("scope", F.when(falls, F.col("fit")).otherwise(F.col("old")).alias("fit"), falls.alias("falls")))
            fallen = best.where("falls").count()
            best = best.drop("falls")
        if not fallen:
            break
    least = best.groupBy(F.expr("left(scope, length(scope) - 2)").alias("scope")).agg(F.min("fit").alias("fit")).select("scope", "fit.*")
    return checkpoint(whitening(least.drop("logdet"), names, CONSISTENT))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """(key, the statistics, base_failed, d2, kept) of each row."""
    names = [*FLOORS]
    rows = docs.select(F.col(key).alias("_k"), F.col(lang).alias("_lang_in"), F.col(source).alias("_source_in"), F.col(text).alias("_text_in"))
    stats = with_statistics(rows, "_text_in").drop("_text_in")
    stats = stats.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    needed = ["_k", "_lang_in", "_source_in", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *names]
    stats = keep(vectors(stats).select(needed), "statistics")
    sound = stats.where(F.col("n_words") >= SOUND)
    scoped = keep(scopes(stats, "_lang_in", "_source_in"), "scoped") if sound.limit(1).count() else stats.withColumn("scope", F.lit("\x1d"))
    fits = fit(scoped.where(F.col("n_words") >= SOUND), names)
    judged = distances(scoped, fits, names)
    far = F.coalesce((F.col("d2") > cutoff) & (F.col("n") >= FEWEST * SHARE / 2), F.lit(False))
    return judged.select(F.col("_k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "d2", (~F.col("base_failed") & ~far).alias("kept"))


def digests(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    """What op3 returns."""
    return judged.select(key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
