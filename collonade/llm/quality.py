"""Quality classifier by Bradley-Terry pairwise ranking.

A document's worth is a linear function of its text statistics.  In a preference
pair one document is labelled better than the other; the weights maximise the
likelihood that the better one wins, a logistic loss on the difference of the two
feature vectors.  The worth of all scored documents is then cut at a quantile, the
share of the training labels that is 0, and mapped so that this cut is a score of 0.3.

Only the fit looks at labels, of at most ``limit`` documents (those of the lowest
hash of their id, so the same at every run); statistics, scores, the share and the
quantile cover all rows.

Defined results: a null text scores as the empty text; texts are read whole; with no
label of either kind to learn from, every score is 0.5; labels on repeated ids count
once (the higher), and of texts with one id the least is learned from; documents of
equal worth have equal scores, so all ties at the cut are accepted; an empty table
gives no rows; other columns are carried in a struct, so only one of the score's own
name is replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from collonade.llm.common import held_out, keep
from collonade.llm.statistics import with_statistics

#: Most labelled documents that a fit uses, preference pairs for each of its documents, and the score at the cut.
LIMIT, PAIRS, CUT = 20_000, 20, 0.3
#: Ranks that approx_percentile tells apart.
ACCURACY = 1_000_000
FEATURES = ["f_words", "f_length", "f_symbols", "f_marks", "f_upper", "f_digits", "f_repeats", "f_lines", "f_fresh", "f_short", "f_mixed"]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the features of each text."""
    df = with_statistics(docs, text)
    n = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    repeats = F.col("n_repeat_words") / n
    return df.withColumns({
        "f_words": F.log1p("n_words"),
        "f_length": F.log1p(F.col("word_chars") / n),
        "f_symbols": F.least(F.col("n_symbols") / n, F.lit(3.0)),
        "f_marks": F.least(F.col("n_marks") / n, F.lit(3.0)),
        "f_upper": F.col("n_upper") / chars,
        "f_digits": F.least(F.col("n_digits") / chars, F.lit(1.0)),
        "f_repeats": repeats,
        "f_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "f_fresh": F.pow(F.col("n_distinct") / n, F.lit(0.5)),
        "f_short": F.exp(-F.col("n_words") / 10.0),
        "f_mixed": F.sqrt(repeats) + F.sqrt(F.least(F.col("n_symbols") / n, F.lit(1.0))),
    })


def rank(x: np.ndarray, y: np.ndarray, seed: int = 7, penalty: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Bradley-Terry weights on standardised features, by Newton steps on the pairs' logistic loss."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    n = PAIRS * len(y)
    d = x[rng.choice(good, n)] - x[rng.choice(bad, n)]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # that the worse one wins
        gradient = penalty * w - d.T @ p / n
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + penalty * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = LIMIT) -> dict | None:
    """Weights and the share of label 0, from labelled rows that are not held out."""
    given = labels.where(F.col(label).isin(0, 1) & ~held_out(F.col(key))).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    chosen = given.orderBy(F.xxhash64("_k"), "_k").limit(limit)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_k")
    rows = rows.groupBy("_k", "_y").agg(F.min(F.coalesce("_text", F.lit(""))).alias("_text"))
    got = features(rows, "_text").select("_k", "_y", *FEATURES).toPandas().sort_values("_k")
    y = got["_y"].to_numpy()
    if not 0 < y.sum() < len(y):
        return None
    x = got[FEATURES].to_numpy(float)
    mean, spread = x.mean(0), x.std(0) + 1e-3
    w = rank((x - mean) / spread, y)
    worth = (x - mean) / spread @ w
    share = given.agg(F.avg((F.col("_y") == 0).cast("double"))).first()[0]
    return {"weights": (w / spread).tolist(), "base": float(-(mean / spread) @ w), "share": share, "good": float(np.median(worth[y == 1]))}


def score(docs: DataFrame, model: dict | None, text: str = "text", name: str = "score", carry: list[str] | None = None) -> DataFrame:
    """Add the score of each text, 0 to 1, with CUT at the quantile of all docs; of their columns only the carried ones, if given.

    The worths are kept, since the quantile needs all of them; so the result can be filtered.
    """
    carry = [c for c in (docs.columns if carry is None else carry) if c != name]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_doc"), F.col(f"`{text}`").alias("_text"))
    unpacked = [F.col("_doc")[c].alias(c) for c in carry]
    if model is None:
        return rows.select(*unpacked, F.lit(0.5).alias(name))
    worth: Column = F.lit(model["base"])
    for f, w in zip(FEATURES, model["weights"], strict=True):
        worth = worth + F.col(f) * w
    scored = keep(features(rows, "_text").withColumn("_worth", worth).select(*unpacked, F.col("_worth").alias(name)), "quality-worths")
    cut = scored.agg(F.percentile_approx(name, model["share"], ACCURACY)).first()[0] or 0.0
    exponent = (F.col(name) - cut) * (4.0 / max(1e-3, model["good"] - cut)) + float(np.log(CUT / (1 - CUT)))
    # At the cut itself rounding must not put the score below CUT.
    value = 1 / (1 + F.exp(-F.least(F.greatest(exponent, F.lit(-30.0)), F.lit(30.0))))
    return scored.withColumn(name, F.when(F.col(name) >= cut, F.greatest(value, F.lit(CUT))).otherwise(value))


def digests(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What op5 returns."""
    scored = score(docs.select(key, F.col(text).alias("_text")), model, "_text", carry=[key])
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
