"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted trees on a bounded labelled sample propose conjunctive rules (every path from a
root), a lasso logistic regression keeps few of them, and the survivors become one Spark
column expression: scoring never leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm import common as C

SAMPLE_ROWS = 20_000
"""Most labelled rows that a fit reads: those with the smallest hash of their id."""


def statistics(text: Column) -> dict[str, Column]:
    """Shares and means that describe a text, given its word count ``__n``; 0 where it has no words."""
    n = F.regexp_count(text, F.lit(C.WORD))
    per_word = lambda pattern: F.coalesce(F.try_divide(F.regexp_count(text, F.lit(pattern)), F.col("__n")), F.lit(0.0))
    count = lambda chars: F.coalesce(F.try_divide(F.length(text) - F.length(F.translate(text, chars, "")), F.col("__n")), F.lit(0.0))
    return {
        "n": n.cast("double"),
        "variety": F.coalesce(F.try_divide(F.size(F.array_distinct(F.split(text, r"[\x20\x09-\x0D]+"))), F.col("__n")), F.lit(0.0)),
        "caps": per_word(r"\p{Lu}{2,}"),
        "marks": per_word(r"[^\p{L}\p{N}\s.,;:'\"()-]{2,}"),
        "shouts": count("!?"),
        "bars": count("|<>{}[]\\"),
        "digits": count("0123456789"),
        "stops": count(".,;:"),
        "lines": count("\n"),
        "length": F.coalesce(F.try_divide(F.length(text), F.col("__n")), F.lit(0.0)),
    }


FEATURES = ("variety", "variety_log", "caps", "marks", "shouts", "bars", "digits", "stops", "lines", "length", "n")


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the struct ``__stats``; a null text counts as empty."""
    text = F.coalesce(F.col("__text"), F.lit(""))
    st = statistics(text)
    base = docs.withColumn("__text", F.col(text_col)).withColumn("__n", st["n"])
    cols = {k: c for k, c in st.items() if k != "n"}
    inner = base.select("*", *[c.alias(f"__{k}") for k, c in cols.items()])
    log = F.try_divide(F.log1p(F.col("__variety") * F.col("__n")), F.log1p("__n"))
    out = inner.withColumn("__variety_log", F.coalesce(log, F.lit(0.0)))
    stats = F.struct(*[F.col(f"__{k}").cast("double").alias(k) for k in FEATURES])
    # one row from a generator: a filter on a score is not pushed below it, where each mention would count anew
    return out.select(*docs.columns, F.explode(F.array(stats)).alias("__stats"))


@dataclass(frozen=True)
class Rule:
    terms: tuple[tuple[int, bool, float], ...]
    """(feature, is it above?, threshold), all of which must hold."""

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, above, t in self.terms:
            out &= (x[:, f] > t) == above
        return out

    def column(self, features: tuple[str, ...], stats: str = "__stats") -> Column:
        out = F.lit(True)
        for f, above, t in self.terms:
            v = F.col(f"{stats}.{features[f]}")
            out = out & ((v > F.lit(t)) if above else (v <= F.lit(t)))
        return out


def _grow(x: np.ndarray, r: np.ndarray, hess: np.ndarray, cuts: list[np.ndarray], depth: int, least: int) -> tuple[list[Rule], np.ndarray]:
    """One regression tree on gradients: its path rules and its fitted values."""
    rules: list[Rule] = []
    fitted = np.zeros(len(x))

    def split(rows: np.ndarray, terms: tuple, d: int) -> None:
        g, h = r[rows].sum(), hess[rows].sum()
        if terms:
            rules.append(Rule(terms))
        best = (1e-6, None)
        if d < depth and len(rows) >= 2 * least:
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                b = np.searchsorted(c, x[rows, f], side="left")
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (r[rows], hess[rows], np.ones(len(rows))))
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < least) | (len(rows) - ns < least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], (f, float(c[k])))
        if best[1] is None:
            fitted[rows] = g / (h + 1)
            return
        f, t = best[1]
        above = x[rows, f] > t
        split(rows[~above], (*terms, (f, False, t)), d + 1)
        split(rows[above], (*terms, (f, True, t)), d + 1)

    split(np.arange(len(x)), (), 0)
    return rules, fitted


def propose(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3) -> list[Rule]:
    """Distinct path rules of boosted trees over quantile cuts."""
    least = max(5, len(x) // 500)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) for f in range(x.shape[1])]
    score, found = np.full(len(x), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        rules, fitted = _grow(x, y - p, p * (1 - p), cuts, depth, least)
        found.update(dict.fromkeys(rules))
        score += rate * fitted
    return list(found)


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Proximal gradient with momentum; rules are scaled by their deviation."""
    scale = np.maximum(a.std(axis=0), 0.02)
    z = (a - a.mean(axis=0)) / scale
    n = len(y)
    step = 4 * n / max(np.linalg.norm(z, 2) ** 2 + n, 1e-9)
    w, b = np.zeros(z.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ vw + vb)))
        nw = vw - step * (z.T @ (p - y)) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * float((p - y).mean())
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w / scale, b - float((a.mean(axis=0) * w / scale).sum())


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float
    features: tuple[str, ...] = FEATURES

    def column(self, stats: str = "__stats") -> Column:
        total = F.lit(self.bias)
        for r, w in zip(self.rules, self.weights):
            total = total + F.when(r.column(self.features, stats), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 2e-3) -> RuleModel:
    """Without labels the score is 0.5, with one class near its label."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        return RuleModel((), (), float(np.log(p / (1 - p))))
    rules = propose(x, y)
    if not rules:
        return RuleModel((), (), float(np.log(y.mean() / (1 - y.mean()))))
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(np.float64)
    w, b = lasso_logistic(a, y, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel(tuple(rules[k] for k in keep), tuple(float(w[k]) for k in keep), float(b))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    """Fit on at most ``sample_rows`` labelled rows that are not held out; rows without a label don't count."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(
        F.max(F.col(label_col).cast("double")).alias("__y"))
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)  # the bound also bounds the broadcast
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")).join(
        F.broadcast(sample), F.col("__id") == F.col(id_col)).select("__id", "__t", "__y")
    got = with_statistics(rows, "__t").select("__id", "__y", "__stats.*").orderBy("__id", *FEATURES).limit(2 * sample_rows).toPandas()
    return fit_rules(got[list(FEATURES)].to_numpy(np.float64), got["__y"].to_numpy(np.float64))


def score(docs: DataFrame, model: RuleModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """Add a score between 0 and 1; empty and null texts get that of a text without words."""
    return with_statistics(docs, text_col).withColumn(out, model.column()).drop("__stats")
