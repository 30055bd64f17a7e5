"""Quality: a sparse rule ensemble whose rules are compiled into Spark column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_each, remainder, saved

#: At most this many labelled rows are learned from, those with the smallest hash of their doc_id: 20 numbers each.
MAX_TRAINING_ROWS = 5_000
THRESHOLD = 0.3
#: Stop-words of the statistics, in the four languages of the corpus.
COMMON = ("the of and to in is that for with der die und den von das le la les de et que des el los en y un une ein eine").split()


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every text that rules speak of, by built-in functions alone. Empty texts give zeros."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = docs.select("doc_id", text.alias("text"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("words"))
    left = lambda pattern: F.length("text") - F.length(F.regexp_replace("text", pattern, ""))
    counts = words.select(
        "doc_id",
        F.length("text").cast("double").alias("chars"),
        F.size("words").cast("double").alias("n_words"),
        F.size(F.array_distinct("words")).cast("double").alias("n_distinct"),
        F.size(F.array_intersect(F.array_distinct(F.transform("words", F.lower)), F.array(*map(F.lit, COMMON)))).cast("double").alias("n_common"),
        left(r"\p{Lu}+").cast("double").alias("upper"),
        left(r"\p{L}+").cast("double").alias("letters"),
        left(r"\p{Nd}+").cast("double").alias("digits"),
        left(r"[%$&#*@^~|<>=+{}\[\]\\/_]+").cast("double").alias("symbols"),
        left(r"[!?]+").cast("double").alias("marks"),
        left(r"[.,;:]+").cast("double").alias("stops"),
        left(r"\n+").cast("double").alias("breaks"),
        (F.size(F.split("text", "\n")) - F.size(F.array_distinct(F.split("text", "\n")))).cast("double").alias("line_copies"),
    )
    per = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0.0)), F.lit(0.0))
    return counts.select(
        "doc_id",
        F.log1p("chars").alias("log_chars"),
        F.log1p("n_words").alias("log_words"),
        per("letters", "n_words").alias("letters_per_word"),
        per("n_distinct", "n_words").alias("distinct_share"),
        per("n_common", "n_distinct").alias("common_share"),
        F.col("n_common").alias("common_words"),
        per("upper", "letters").alias("upper_share"),
        per("letters", "chars").alias("letter_share"),
        per("digits", "chars").alias("digit_share"),
        per("symbols", "n_words").alias("symbols_per_word"),
        per("marks", "n_words").alias("marks_per_word"),
        per("stops", "n_words").alias("stops_per_word"),
        per("breaks", "n_words").alias("breaks_per_word"),
        F.col("line_copies").alias("line_copies"),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, above?, bound) and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[s] > b) if above else (x[s] <= b) for s, above, b in self.terms])

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [(F.col(s) > b) if above else (F.col(s) <= b) for s, above, b in self.terms])


@dataclass(frozen=True)
class RuleEnsemble:
    rules: tuple[Rule, ...]
    bias: float

    def column(self) -> Column:
        """The score as a column expression over statistics()."""
        total = reduce(lambda a, r: a + F.when(r.column(), r.weight).otherwise(0.0), self.rules, F.lit(self.bias))
        return 1 / (1 + F.exp(-total))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, names: list[str], depth: int, least: int, path=()) -> list[tuple]:
    """The paths of a regression tree grown on gradients g and curvatures h, with the value at each end: (path, value)."""
    value = -g.sum() / (h.sum() + 1.0)
    best = (1e-6, None)
    if depth and len(g) >= 2 * least:
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
            at = np.flatnonzero(v[:-1] < v[1:])
            at = at[(at + 1 >= least) & (len(g) - at - 1 >= least)]
            if len(at):
                gain = gs[at] ** 2 / (hs[at] + 1) + (gs[-1] - gs[at]) ** 2 / (hs[-1] - hs[at] + 1) - gs[-1] ** 2 / (hs[-1] + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, float((v[at[k]] + v[at[k] + 1]) / 2)))
    if best[1] is None:
        return [(path, value)]
    j, bound = best[1]
    low = x[:, j] <= bound
    return _tree(x[low], g[low], h[low], names, depth - 1, least, (*path, (names[j], False, bound))) + _tree(
        x[~low], g[~low], h[~low], names, depth - 1, least, (*path, (names[j], True, bound))
    )


def fit(x: dict[str, np.ndarray], y: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3, penalty: float = 0.002, steps: int = 600) -> RuleEnsemble:
    """Boosted trees give the rules (every prefix of every path), proximal gradient steps the lasso logistic weights."""
    if len(y) == 0:
        return RuleEnsemble((), 0.0)
    names = sorted(x)
    matrix = np.column_stack([x[n] for n in names])
    f, paths, least = np.zeros(len(y)), {}, max(3, len(y) // 200)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        for path, value in _tree(matrix, p - y, p * (1 - p), names, depth, least):
            if path:
                f[Rule(path).holds(x)] += rate * value
            for k in range(1, len(path) + 1):
                paths.setdefault(tuple(sorted(path[:k])), None)
    rules = [Rule(t) for t in paths]
    held = [r.holds(x).astype(float) for r in rules]
    unique = {h.tobytes(): k for k, h in reversed(list(enumerate(held))) if 0 < h.sum() < len(y)}
    kept = sorted(unique.values())
    rules, a = [rules[k] for k in kept], np.column_stack([np.ones(len(y)), *[held[k] for k in kept]])
    w, v, t = np.zeros(a.shape[1]), np.zeros(a.shape[1]), 1.0
    step = 4 * len(y) / (np.linalg.norm(a, 2) ** 2)
    for _ in range(steps):
        grad = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / len(y)
        new = v - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return RuleEnsemble(tuple(Rule(r.terms, float(c)) for r, c in zip(rules, w[1:]) if c), float(w[0]))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> RuleEnsemble:
    """Learn from the labelled rows outside the held-out fold (crc32 of doc_id modulo 5 is 0), max_rows of them at most."""
    chosen = saved(
        labels.where("doc_id is not null and quality is not null")
        .where(remainder(F.col("doc_id"), 5) != 0)
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    known = one_each(docs.join(F.broadcast(chosen), "doc_id", "left_semi"), "doc_id", "text")
    sample = statistics(known).join(F.broadcast(chosen), "doc_id").toPandas()
    sample = sample.drop_duplicates("doc_id").sort_values("doc_id")
    return fit({c: sample[c].to_numpy(float) for c in sample.columns if c not in ("doc_id", "quality")}, sample["quality"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if score >= threshold, else 0).

    Statistics and score are column expressions, so whole texts are scored in the JVM in one pass without a shuffle.
    Null texts count as empty and get a score. A null doc_id is scored, with held_out null; repeated rows get a row
    each; without labels every score is 0.5. Columns other than doc_id and text are not looked at.
    """
    model = train(docs, labels)
    return (
        statistics(docs)
        .select("doc_id", model.column().alias("score"))
        .select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
    )
