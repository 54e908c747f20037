"""Toxicity as ordered severity grades: a cumulative-link model on sparse words.

P(grade <= k | x) = sigmoid(theta_k - w.x): one weight vector for all grades,
one increasing threshold for each step between them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samewise.llm.columns import bound_batches, documents, fresh, pick
from samewise.plans.materialize import discard, save

WORD = re.compile(r"[^\W\d_]+")
SAMPLE_ROWS = 8_000  # labelled rows of each class that a model is fitted on, at most (about: rows are chosen by hash)
MAX_FEATURES = 20_000  # words that the model weighs, the surest; the others say nothing about a text
MIN_DF = 4  # rows of the sample that a word stands in at least
STEM = 4
SURE = 15.0  # squared z of a word's two rates
REJECT_FROM = 0.3  # probability of a grade above 0


def features(text: str | None) -> set[str]:
    """The distinct words of the whole text, and the stems (first four letters, "^" before) of the longer ones."""
    words = set(WORD.findall(text.lower())) if text else set()
    return words | {"^" + w[:STEM] for w in words if len(w) > STEM}


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: list[float]

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """Rows of P(grade = 0), P(grade = 1), ..."""
        below = 1 / (1 + np.exp(-np.clip(np.asarray(self.thresholds)[None, :] - score[:, None], -60, 60)))
        edge = np.ones((len(score), 1))
        return np.diff(np.hstack([0 * edge, below, edge]), axis=1)


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_features: int, l2: float = 0.3, steps: int = 300, rate: float = 0.08):
    """Weighted maximum likelihood with an L2 penalty, by Adam over the whole sample.

    rows, cols: the non-zero (presence) features; grades 0..K-1, K >= 2.
    Thresholds are a first value and the logarithms of the gaps after it.
    """
    n, k = len(grade), int(grade.max()) + 1
    share = np.cumsum(np.bincount(grade, weights=weight, minlength=k))[:-1] / weight.sum()
    start = np.log(share / (1 - share))
    w, first, gaps = np.zeros(n_features), start[0], np.log(np.maximum(np.diff(start), 0.1))
    params = np.concatenate([w, [first], gaps])
    m, v = np.zeros_like(params), np.zeros_like(params)
    up = np.where(grade < k - 1, grade, 0)
    down = np.where(grade > 0, grade - 1, 0)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -60, 60)))
    for t in range(1, steps + 1):
        w, first, gaps = params[:n_features], params[n_features], params[n_features + 1 :]
        theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(rows, weights=w[cols], minlength=n)
        hi = np.where(grade < k - 1, sigmoid(theta[up] - score), 1.0)
        lo = np.where(grade > 0, sigmoid(theta[down] - score), 0.0)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        g_score = weight * (d_hi - d_lo)  # of the negative log likelihood
        g_theta = np.bincount(down, weights=weight * d_lo * (grade > 0), minlength=k - 1) - np.bincount(up, weights=weight * d_hi * (grade < k - 1), minlength=k - 1)
        tail = np.cumsum(g_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(cols, weights=g_score[rows], minlength=n_features) + l2 * w, [tail[0]], tail[1:] * np.exp(gaps)])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        params = params - rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    theta = params[n_features] + np.concatenate([[0], np.cumsum(np.exp(params[n_features + 1 :]))])
    return params[:n_features], theta


def severity_grades(present: list[np.ndarray], flagged: np.ndarray, names: list[str]) -> np.ndarray:
    """Grades 0..3 where labels only say yes or no.

    0 for the unflagged. The flagged get 1, 2 from two and 3 from four stems
    (or words no longer than one) on that are at least eight times as frequent
    in flagged texts.
    """
    count = np.zeros((2, len(names)))
    for cols, f in zip(present, flagged, strict=True):
        count[int(f), cols] += 1
    n1, n0 = max(flagged.sum(), 1), max((~flagged).sum(), 1)
    telling = ((count[1] + 0.5) / (n1 + 1) >= 8 * (count[0] + 0.5) / (n0 + 1)) & (count[1] >= MIN_DF)
    telling &= np.array([w[0] == "^" or len(w) <= STEM for w in names])
    hits = np.array([int(telling[c].sum()) for c in present])
    return np.where(flagged, 1 + (hits >= 2) + (hits >= 4), 0)


def telling_words(sample: DataFrame, n1: int, n0: int) -> list[str]:
    """The words of (grade, words) whose rates in the n1 flagged and the n0 other rows differ surely, surest first, at most MAX_FEATURES.

    Counted by Spark: the driver gets the chosen words only.
    """
    counted = sample.select((F.col("grade") > 0).cast("int").alias("flagged"), F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"), F.sum("flagged").alias("in1"))
    every = F.col("df") / (n1 + n0)
    z2 = F.pow(F.col("in1") / n1 - (F.col("df") - F.col("in1")) / n0, 2) / F.greatest(every * (1 - every) * (1 / n1 + 1 / n0), F.lit(1e-12))
    # ties by the word itself
    kept = counted.where(F.col("df") >= MIN_DF).select("word", z2.alias("z2")).where(F.col("z2") >= SURE).orderBy(F.desc("z2"), "word").limit(MAX_FEATURES)
    return [r["word"] for r in kept.collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> OrdinalModel:
    """A model from a bounded sample of the labelled rows.

    About sample_rows rows with grade 0 and as many above are taken, by a hash
    of the id, and weighted back to their shares. If only 0 and 1 occur,
    severity_grades() tells the flagged apart. Null ids, grades and texts are
    left out; of several labels of an id the highest counts. Without both
    classes the model gives grade 0 to every text.
    """
    spark = docs.sparkSession
    graded = pick(labels, id=id_col, grade=grade_col).where("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.max(F.col("grade").cast("int")).alias("grade"))
    sizes = {r["flagged"]: r["n"] for r in graded.groupBy((F.col("grade") > 0).alias("flagged")).agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {True, False}:
        return OrdinalModel({}, [60.0])
    share = {k: min(1.0, sample_rows / n) for k, n in sizes.items()}
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = graded.where(chance < F.when(F.col("grade") > 0, share[True]).otherwise(share[False]))

    def words(batches):
        for b in batches:
            lists = [sorted(features(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.string()))], names=["grade", "words"])

    # the sample's ids are bounded by sample_rows, so they can go to every task
    rows = pick(docs, id=id_col, text=text_col).where("text IS NOT NULL").join(F.broadcast(chosen), "id").select("grade", "text")
    sample = save(rows.mapInArrow(words, "grade int, words array<string>"), "toxicity-sample")
    n = {r["flagged"]: r["n"] for r in sample.groupBy((F.col("grade") > 0).alias("flagged")).agg(F.count("*").alias("n")).collect()}
    names = telling_words(sample, n[True], n[False]) if set(n) == {True, False} else []
    if not names:
        discard(sample)
        return OrdinalModel({}, [60.0])
    place = spark.sparkContext.broadcast({w: i for i, w in enumerate(names)})  # at most MAX_FEATURES words

    def coded(batches):
        at = place.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[at[w] for w in own if w in at] for own in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["grade", "cols"])

    table = sample.mapInArrow(coded, "grade int, cols array<int>").toArrow()
    discard(sample)
    grade = np.asarray(table.column("grade").combine_chunks())
    lists = [np.array(x, dtype=np.int64) for x in table.column("cols").to_pylist()]
    # the order of rows must not matter
    order = sorted(range(len(lists)), key=lambda i: (int(grade[i]), lists[i].tolist()))
    grade, lists = grade[order], [lists[i] for i in order]
    flagged = grade > 0
    rows_, cols_ = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)
    if grade.max() == 1:
        grade = severity_grades(lists, flagged, names)
    # grades that don't occur have no threshold of their own
    level = {g: i for i, g in enumerate(sorted(set(grade.tolist())))}
    weight = np.where(flagged, 1 / share[True], 1 / share[False])
    weight = weight * len(weight) / weight.sum()
    w, theta = fit_ordinal(rows_, cols_, np.array([level[g] for g in grade.tolist()]), weight, len(names))
    return OrdinalModel({x: float(w[i]) for i, x in enumerate(names) if abs(w[i]) > 1e-4}, [float(x) for x in theta])


def with_severity(docs: DataFrame, model: OrdinalModel, text_col: str = "text") -> DataFrame:
    """docs with struct `toxicity`: severity (expected grade), p_toxic (chance of a grade above 0), grade (the likeliest), toxic (p_toxic >= 0.3).

    Null, empty and wordless texts have severity 0. The column is named
    _toxicity and so on if docs has one. Every row and column is kept.
    """

    bound_batches(docs)

    @F.pandas_udf("struct<severity: double, p_toxic: double, grade: int, toxic: boolean>")
    def score(texts):
        import pandas as pd

        s, wordless = np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        for i, t in enumerate(texts):  # one document's words at a time
            found = features(t)
            wordless[i] = not found
            s[i] = sum(model.weights[w] for w in sorted(found & model.weights.keys()))
        p = model.probabilities(s)
        p[wordless] = np.eye(p.shape[1])[0]
        return pd.DataFrame({"severity": p @ np.arange(p.shape[1]), "p_toxic": 1 - p[:, 0], "grade": p.argmax(axis=1).astype("int32"), "toxic": 1 - p[:, 0] >= REJECT_FROM})

    return docs.withColumn(fresh(docs, "toxicity"), score(F.col(f"`{text_col}`")))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """Expected severity of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_severity(docs, model).select("doc_id", "toxicity.*")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
