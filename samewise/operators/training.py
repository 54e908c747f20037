"""Features and figures for supervised scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samewise.functions.text import words
from samewise.operators.decisions import wilson


def tfidf(names: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, w): term counts times smoothed idf, rows of length one."""
    tokens = names.select(key, F.explode(words(F.lower(text))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))
    total = names.where(F.col(text).isNotNull()).agg(F.count("*").alias("docs"))  # one row
    df = tokens.groupBy("token").agg(F.count("*").alias("df"))
    raw = tokens.join(df, "token").crossJoin(F.broadcast(total)).withColumn("w", F.col("tf") * (F.log((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "token", (F.col("w") / F.col("norm")).alias("w"))


def cosine(pairs: DataFrame, weights: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """(left, right, cosine) of the given pairs."""
    l = weights.select(F.col(key).alias(left), "token", F.col("w").alias("wl"))
    r = weights.select(F.col(key).alias(right), "token", F.col("w").alias("wr"))
    dots = pairs.select(left, right).join(l, left).join(r, [right, "token"]).groupBy(left, right).agg(F.sum(F.col("wl") * F.col("wr")).alias("cosine"))
    return pairs.select(left, right).join(dots, [left, right], "left").select(left, right, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def auc_brier(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """(auc, brier, n): counts by score first, so the ordered sum runs over distinct scores only; auc is null with one class."""
    per = rows.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(truth).cast("long")).alias("p"), F.count("*").alias("n"), F.sum(F.pow(F.col(score) - F.col(truth).cast("double"), 2)).alias("b"))
    below = Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    neg = F.col("n") - F.col("p")
    ranked = per.withColumn("wins", F.col("p") * (F.coalesce(F.sum(neg).over(below), F.lit(0)) + neg / 2))
    t = ranked.agg(F.sum("wins").alias("wins"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("b").alias("b"))
    return t.select(F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), F.round(F.col("wins") / (F.col("p") * (F.col("n") - F.col("p"))), 6)).alias("auc"), F.round(F.col("b") / F.col("n"), 6).alias("brier"), "n")


def reliability(rows: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate, low, high) with Wilson bounds."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("m"), F.sum(F.col(truth).cast("long")).alias("h"))
    low, high = wilson(F.col("h"), F.col("n"))
    return per.select("bin", "n", F.round("m", 6).alias("mean_score"), F.round(F.col("h") / F.col("n"), 6).alias("rate"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def by_score(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """(s, n, h, above, hits_above, every, hits): counts by distinct score with sums from the top; what all lines below are read from.

    Graded rows are labels, made by people; their distinct scores fit one task.
    """
    y = F.col(truth).cast("long")
    per = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(y).alias("h"))
    top, whole = Window.orderBy(F.desc("s")), Window.partitionBy(F.lit(1))
    return per.select("s", "n", "h", F.sum("n").over(top).alias("above"), F.sum("h").over(top).alias("hits_above"), F.sum("n").over(whole).alias("every"), F.sum("h").over(whole).alias("hits"))


def lines(rows: DataFrame, score: str, truth: str, target: float, bound: bool = True) -> DataFrame:
    """(accept, reject): the lowest score from which on precision reaches the target, the highest below which non-matches do.

    bound: by the lower Wilson bound, else by the plain share. Lines that cross
    leave no reject; without enough rows a line is null.
    """
    c = by_score(rows, score, truth)
    below, no = F.col("every") - F.col("above"), (F.col("every") - F.col("hits")) - (F.col("above") - F.col("hits_above"))
    share = lambda x, n: F.when(n > 0, wilson(x, n)[0] if bound else x / n)
    got = c.agg(F.min(F.when(share(F.col("hits_above"), F.col("above")) >= target, F.col("s"))).alias("accept"), F.max(F.when(share(no, below) >= target, F.col("s"))).alias("reject"))
    return got.select("accept", F.when(F.col("accept").isNull() | (F.col("reject") <= F.col("accept")), F.col("reject")).alias("reject"))


def separation(rows: DataFrame, score: str, truth: str, universe: DataFrame, purity: float) -> DataFrame:
    """One row: both lines at a purity and how many rows of the universe fall to each side."""
    c = by_score(rows, score, truth)
    below, no = F.col("every") - F.col("above"), (F.col("every") - F.col("hits")) - (F.col("above") - F.col("hits_above"))
    line = c.agg(F.min(F.when(F.col("hits_above") / F.col("above") >= purity, F.col("s"))).alias("accept"), F.max(F.when((below > 0) & (no >= purity * below), F.col("s"))).alias("reject"))
    u = universe.select(F.col(score).alias("u")).crossJoin(F.broadcast(line))  # one row
    return u.groupBy("accept", "reject").agg(F.count_if(F.col("u") >= F.col("accept")).alias("n_accept"), F.count_if(F.col("u") < F.col("reject")).alias("n_reject"), F.count("*").alias("n"))


def conformal_lines(rows: DataFrame, key: str, score: str, truth: str, target: float) -> DataFrame:
    """One row (accept, reject, n_accept, accept_error, n_reject, reject_error): lines picked on one half of the labels by Wilson bounds, errors that they make on the other.

    The halves are told by a hash of the key, so they are the same whatever the partitions.
    """
    half = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 2
    line = lines(rows.where(half == 0), score, truth, target)
    s, y = F.col(score), F.col(truth).cast("boolean")
    above, under = s >= F.col("accept"), s < F.col("reject")
    held = rows.where(half == 1).crossJoin(F.broadcast(line))  # one row
    got = held.groupBy("accept", "reject").agg(F.count_if(above).alias("n_accept"), F.count_if(above & ~y).alias("ea"), F.count_if(under).alias("n_reject"), F.count_if(under & y).alias("er"))
    safe = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return got.select("accept", "reject", "n_accept", safe(F.col("ea"), F.col("n_accept")).alias("accept_error"), "n_reject", safe(F.col("er"), F.col("n_reject")).alias("reject_error"))


def average_precision(rows: DataFrame, score: str, truth: str) -> DataFrame:
    """(average_precision): precision at each distinct score weighed by the recall it adds; null without a match."""
    c = by_score(rows, score, truth)
    return c.agg(F.round(F.sum(F.when(F.col("hits") > 0, F.col("h") / F.col("hits") * F.col("hits_above") / F.col("above"))), 6).alias("average_precision"))


def calibration_error(rows: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """(ece): the mean gap between score and rate over bins, by their share of rows."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    per = rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("m"), F.avg(F.col(truth).cast("double")).alias("r"))
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("r") - F.col("m"))) / F.sum("n"), 6).alias("ece"))


def at_line(rows: DataFrame, score: str, truth: str, line: float) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1)."""
    p, y = F.col(score) >= line, F.col(truth).cast("boolean")
    t = rows.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    safe = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return t.select("tp", "fp", "fn", safe(tp, tp + fp).alias("precision"), safe(tp, tp + fn).alias("recall"), safe(2 * tp, 2 * tp + fp + fn).alias("f1"))


def monotone_rate(rows: DataFrame, score: str, truth: str, key: str, bins: int = 10) -> DataFrame:
    """(rho, rising): whether the rate rises with the score over bins of equal size; ties in order of key."""
    ranked = rows.withColumn("q", F.ntile(bins).over(Window.orderBy(score, key)))
    per = ranked.groupBy("q").agg(F.avg(score).alias("m"), F.avg(F.col(truth).cast("double")).alias("r"))
    w = Window.orderBy("q")
    mean_rank = lambda c: F.rank().over(Window.orderBy(c)) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2
    out = per.select(mean_rank("m").alias("a"), mean_rank("r").alias("b"), (F.col("r") - F.lag("r").over(w)).alias("step"))
    return out.agg(F.round(F.corr("a", "b"), 6).alias("rho"), F.coalesce(F.min("step") >= -1e-9, F.lit(True)).alias("rising"))


def bimodality(rows: DataFrame, score: str, review: float = 0.4, high: float = 0.7) -> DataFrame:
    """(bc, extreme, middle): Sarle's coefficient, and the shares near the ends and between the lines."""
    s = F.col(score)
    t = rows.agg(F.skewness(s).alias("g"), F.kurtosis(s).alias("k"), F.count(s).alias("n"), F.avg(((s < 0.05) | (s > 0.95)).cast("double")).alias("extreme"), F.avg(((s >= review) & (s < high)).cast("double")).alias("middle"))
    n = F.col("n")
    bc = (F.col("g") * F.col("g") + 1) / (F.col("k") + 3 * (n - 1) * (n - 1) / ((n - 2) * (n - 3)))
    return t.select(F.when(n >= 4, F.round(bc, 6)).alias("bc"), F.round("extreme", 6).alias("extreme"), F.round("middle", 6).alias("middle"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(agree, kappa) of two verdicts: both marginals come from one counted table."""
    cells = rows.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("x")), cells.groupBy("b").agg(F.sum("n").alias("y"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("c"))
    t = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).crossJoin(chance)  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("c") / F.col("n") / F.col("n")
    return t.select(F.round(po, 6).alias("agree"), F.when(pe < 1, F.round((po - pe) / (1 - pe), 6)).alias("kappa"))


def folds(groups: DataFrame, group: str, k: int = 5) -> dict:
    """group to fold: the largest into the emptiest fold. Groups are components of labelled units; people label few."""
    load, out = [0] * k, {}
    for r in groups.groupBy(group).agg(F.count("*").alias("n")).orderBy(F.desc("n"), group).toLocalIterator():
        f = load.index(min(load))
        out[r[group]], load[f] = f, load[f] + r["n"]
    return out


def collapsed(scores: DataFrame, score: str, review_before: int, review: float, accept: float, distinct: int = 4, share: float = 0.05) -> bool:
    """A model of fewer than four scores, or with under a twentieth of the review band there was, is refused."""
    s = F.col(score)
    r = scores.agg(F.count_distinct(s).alias("d"), F.count_if((s >= review) & (s < accept)).alias("n")).head()
    return r["d"] < distinct or r["n"] < share * review_before
