"""A quality classifier from a sparse ensemble of rules.

Shallow trees are grown on bootstrap samples of labelled texts' statistics. Each path
from a root to a node is a rule: a conjunction of bounds. A logistic model with a lasso
penalty gives most rules weight zero. What is left is compiled into one Spark column
expression over native statistics, so scoring runs no Python."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_share, read_table, small_side
from .quality_rules import let, ratio, statistics, words_of

#: Labelled rows that are learnt from, about.
SAMPLE_ROWS = 12_000
TREES, DEPTH, BINS, LEAST_LEAF = 24, 3, 24, 12
PENALTY, STEPS = 0.002, 400
FEATURES = (
    "mean_word_chars", "symbol_ratio", "exclamation_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_ratio", "unique_ratio", "upper_ratio",
    "digit_ratio", "bar_ratio", "stop_ratio", "log_words",
)

Rule = tuple[tuple[int, bool, float], ...]  # (feature, above, bound)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """_id, the columns of keep, and FEATURES. Null texts count as empty: all are 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("_id"), *keep, F.col(text_col).alias("text"))
    more = base.select(
        "_id", *keep, "text", let(words_of(text), lambda w: F.size(F.array_distinct(w))).alias("n_unique"), F.regexp_count(text, F.lit("[A-Z]")).alias("n_upper"),
        F.regexp_count(text, F.lit("[0-9]")).alias("n_digits"), F.regexp_count(text, F.lit(r"\|")).alias("n_bars"), F.regexp_count(text, F.lit("[.?,;:]")).alias("n_stops"),
    )
    s = statistics(more, "text", ("_id", *keep, "n_unique", "n_upper", "n_digits", "n_bars", "n_stops", "text"))
    c = F.col
    return s.select(
        "_id", *keep, "mean_word_chars", "symbol_ratio", "exclamation_ratio", "stop_word_ratio", "dup_line_ratio", "repeat_ratio", ratio(c("n_unique"), c("n_words")).alias("unique_ratio"),
        ratio(c("n_upper"), c("word_chars")).alias("upper_ratio"), ratio(c("n_digits"), c("word_chars")).alias("digit_ratio"), ratio(c("n_bars"), c("n_words")).alias("bar_ratio"),
        ratio(c("n_stops"), c("n_words")).alias("stop_ratio"), F.log1p(c("n_words")).alias("log_words"),
    )


def grown(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Rules of TREES trees: every path from a root to a node below it."""
    rng = np.random.default_rng(seed)
    bounds = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(b, x[:, k], side="left") for k, b in enumerate(bounds)])  # > bound j exactly if bin > j
    found: dict[Rule, None] = {}

    def split(rows: np.ndarray, rule: Rule) -> None:
        total, ones = len(rows), y[rows].sum()
        if len(rule) == DEPTH or total < 2 * LEAST_LEAF or ones in (0, total):
            return
        best = None
        for k in rng.choice(x.shape[1], size=max(3, x.shape[1] // 2), replace=False):
            n = np.bincount(binned[rows, k], minlength=len(bounds[k]) + 1).cumsum()[:-1]
            p = np.bincount(binned[rows, k], weights=y[rows], minlength=len(bounds[k]) + 1).cumsum()[:-1]
            ok = np.nonzero((n >= LEAST_LEAF) & (total - n >= LEAST_LEAF))[0]
            if len(ok):
                n, p = n[ok], p[ok]
                gini = p * (n - p) / n + (ones - p) * (total - n - ones + p) / (total - n)
                j = int(gini.argmin())
                if best is None or gini[j] < best[0]:
                    best = (gini[j], int(k), int(ok[j]))
        if best is None:
            return
        _, k, j = best
        for above in (False, True):
            own = (*rule, (k, above, float(bounds[k][j])))
            found[tuple(sorted(own))] = None
            split(rows[(binned[rows, k] > j) == above], own)

    for _ in range(TREES):
        split(rng.integers(len(x), size=len(x)), ())
    return list(found)


def held(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for r, rule in enumerate(rules):
        for k, above, bound in rule:
            out[:, r] *= (x[:, k] > bound) == above
    return out


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the logistic model by accelerated proximal steps."""
    n, m = z.shape
    mean = z.mean(0)
    centred = z - mean
    step = 4 * n / max(np.linalg.norm(centred, 2) ** 2, 1e-9) if m else 1.0
    step = min(step, 4.0)
    w, b = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    v, t, old = w.copy(), 1.0, w.copy()
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(centred @ v + b, -35, 35))) - y
        g = centred.T @ error / n
        w = v - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b -= 2 * error.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, old, t = w + (t - 1) / t2 * (w - old), w, t2
    return w, b - float(w @ mean)


def fitted(x: np.ndarray, y: np.ndarray) -> dict:
    """Rules with weights that aren't zero, and the intercept. Without both labels there are
    no rules, and the score is the share of label 1 (0.5 without rows)."""
    if not len(y) or y.min() == y.max():
        return {"rules": [], "weights": [], "intercept": float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))}
    rules = grown(x, y)
    w, b = lasso(held(rules, x), y)
    used = np.nonzero(np.abs(w) > 1e-6)[0]
    return {"rules": [rules[k] for k in used], "weights": [float(w[k]) for k in used], "intercept": float(b)}


def compiled(model: dict) -> Column:
    """The score as a column expression over FEATURES."""
    total = F.lit(model["intercept"])
    for rule, weight in zip(model["rules"], model["weights"]):
        holds = F.lit(True)
        for k, above, bound in rule:
            holds = holds & (F.col(FEATURES[k]) > bound if above else F.col(FEATURES[k]) <= bound)
        total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learnt(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> dict:
    """A model from labelled rows; of more than sample_rows about that many are taken by a
    hash of the id. Several labels of one id count by their majority."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    n = known.count()
    few = known.where(F.xxhash64(F.col("_id").cast("string"), F.lit("quality sample")) <= hash_share(sample_rows / max(n, 1)))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(small_side(few), "_id")
    rows = features(own, "_id", "text", ("y",)).toPandas().sort_values(["_id", *FEATURES])
    return fitted(rows[list(FEATURES)].to_numpy(float), rows["y"].to_numpy(float))


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted.

    Null and empty texts have a score too: all their features are 0. Only id and text are
    read, so clashing names don't matter; repeated rows and null ids come back as they
    are; an empty table gives an empty result; texts are read whole."""
    out = features(docs, id_col, text_col).select(F.col("_id").alias(id_col), compiled(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = learnt(docs, labels.where(~held_out()))
    return scored(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
