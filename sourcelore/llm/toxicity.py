"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and their first letters, hashed. The machine adds to a linear score
the products of pairs of terms, factorised: what is harmless alone and not together, such as an insult with the name
of a group, has a weight of its own.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelore.llm.common import id_crc_mod, whole_text

#: Terms are hashed to so many places.
PLACES = 1 << 20
#: At most so many labelled rows of each class are learned from: those with the smallest hash of their id.
MOST_PER_CLASS = 8_000
_WORD = re.compile(r"\w+")


def word_terms(token: str) -> tuple[int, ...]:
    """The places of a white-space separated token: each word in it, and its first three, four and five letters."""
    out = []
    for word in _WORD.findall(token):
        out.append(zlib.crc32(f"w {word}".encode()) % PLACES)
        out += [zlib.crc32(f"p {word[:n]}".encode()) % PLACES for n in (3, 4, 5) if len(word) > n]
    return tuple(out)


def text_terms(text: str) -> np.ndarray:
    """The distinct places of a text, sorted."""
    return np.array(sorted({x for token in set(text.lower().split()) for x in word_terms(token)}), dtype=np.int64)


class Machine:
    """``score = sigmoid(bias + sum w + half of sum over factors of (sum v)^2 - sum v^2)`` over the terms present."""

    def __init__(self, bias: float, terms: np.ndarray, w: np.ndarray, v: np.ndarray) -> None:
        self.bias, self.w, self.v = bias, w, v
        self.at = {int(t): i for i, t in enumerate(terms)}
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        known, at = self.known, self.at
        if len(known) > 500_000:
            known.clear()
        found: set[int] = set()
        for token in set(text.lower().split()):
            own = known.get(token)
            if own is None:
                own = known[token] = tuple(at[x] for x in word_terms(token) if x in at)
            if own:
                found.update(own)
        own = np.array(sorted(found), dtype=np.int64)
        v = self.v[own]
        z = self.bias + self.w[own].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[np.ndarray], y: np.ndarray, factors: int = 4, epochs: int = 40, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Bias, places, linear weights and factors, by Adam on logistic loss where both classes weigh the same.

    All places that tell the classes apart take part: those with a chi-square of at least 6.6 (one in a hundred by chance) and two texts.
    """
    n, pos = len(y), float(y.sum())
    if pos == 0 or pos == n:
        rate = np.clip((pos + 0.5) / (n + 1), 1e-3, 1 - 1e-3)
        return float(np.log(rate / (1 - rate))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors))
    row = np.repeat(np.arange(n), [len(t) for t in texts])
    terms, col = np.unique(np.concatenate(texts) if len(row) else np.zeros(0, np.int64), return_inverse=True)
    df = np.bincount(col, minlength=len(terms)).astype(float)
    tp = np.bincount(col, weights=y[row], minlength=len(terms))
    e = df * pos / n
    chi = (tp - e) ** 2 / np.maximum(e, 1e-9) + (tp - e) ** 2 / np.maximum(df - e, 1e-9)
    good = np.flatnonzero((chi >= 6.6) & (df >= 2))
    place = np.full(len(terms), -1)
    place[good] = np.arange(len(good))
    keep = place[col] >= 0
    row, col, m = row[keep], place[col[keep]], len(good)
    rng = np.random.default_rng(seed)
    w, v, b = np.zeros(m), rng.normal(0, 0.02, (m, factors)), -1.0
    weight = np.where(y > 0, 0.5 / pos, 0.5 / (n - pos)) * n
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (np.zeros(1), w, v)]
    step = 0
    first = np.searchsorted(row, np.arange(n + 1))
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, 512):
            some = order[at : at + 512]
            size = first[some + 1] - first[some]
            r = np.repeat(np.arange(len(some)), size)
            c = col[np.repeat(first[some] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
            vc = v[c]
            total = np.stack([np.bincount(r, weights=vc[:, f], minlength=len(some)) for f in range(factors)], 1)
            square = np.bincount(r, weights=(vc**2).sum(1), minlength=len(some))
            z = b + np.bincount(r, weights=w[c], minlength=len(some)) + 0.5 * ((total**2).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[some]) * weight[some] / len(some)
            gw = np.bincount(c, weights=g[r], minlength=m) + 1e-5 * w
            pull = g[r][:, None] * (total[r] - vc)
            gv = np.stack([np.bincount(c, weights=pull[:, f], minlength=m) for f in range(factors)], 1) + 1e-4 * v
            step += 1
            moved = []
            for grad, (m1, m2), rate in zip((np.array([g.sum()]), gw, gv), state, (0.05, 0.05, 0.02)):
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad**2 - m2)
                moved.append(rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8))
            b, w, v = b - float(moved[0][0]), w - moved[1], v - moved[2]
    return float(b), terms[good], w, v


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, most_per_class: int = MOST_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Machine:
    """Learn a machine from the labelled rows for which ``learn_from`` (a predicate on ``labels``) holds.

    Of each class at most ``most_per_class`` ids take part, by a hash of the id: this bound fixes what is broadcast (ids
    and labels only) and what the one training task reads, at any size of the table. An id labelled more than once
    counts as its largest label, an id with several texts by the one of the least hash; null ids and labels don't count.
    Null and empty texts have no terms; of very long texts the distinct terms count. Without labelled texts, an empty
    table included, or with one class only, the score is constant. The model comes to the driver: a row for each term of
    the sample that tells the classes apart.
    """
    spark = docs.sparkSession
    known = labels if learn_from is None else labels.where(learn_from)
    known = known.select(F.col(id_col).alias("id"), (F.col(label_col) > 0).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    one = [known.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(most_per_class) for c in (0, 1)]
    sample = one[0].union(one[1])

    @F.pandas_udf("array<int>")
    def terms(texts: pd.Series) -> pd.Series:
        return texts.map(text_terms)

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("body")).join(F.broadcast(sample), "id")
    rows = rows.select("id", "y", F.xxhash64("body").alias("h"), terms("body").alias("terms")).groupBy("id", "y").agg(F.min_by("terms", "h").alias("terms"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["id", "y"], kind="stable")
        b, places, w, v = train([np.asarray(t, dtype=np.int64) for t in group["terms"]], group["y"].to_numpy(float))
        return pd.DataFrame({"place": [-1, *places.tolist()], "w": [b, *w.tolist()], "v": [[], *v.tolist()]})

    model = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(run, "place int, w double, v array<double>").toPandas().sort_values("place")
    if model.empty:
        return Machine(0.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 1)))
    rest = model[model["place"] >= 0]
    v = np.array(rest["v"].tolist(), dtype=float).reshape(len(rest), -1) if len(rest) else np.zeros((0, 1))
    return Machine(float(model["w"].iloc[0]), rest["place"].to_numpy(), rest["w"].to_numpy(float), v)


def score_column(machine: Machine, text: Column) -> Column:
    """The machine's score of a text column, 0 to 1. Empty and null texts get the score of the bias."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([machine.score(t or "") for t in texts], dtype="float64")

    return run(text)


def score(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """``docs`` with ``toxicity``, the score of each whole text (a column of that name is replaced). All rows stay, repeats too; null
    and empty texts get the score of no terms, an empty table gives an empty result."""
    return docs.withColumn("toxicity", score_column(machine, whole_text(text_col)))


def training_rows(id_col: str = "doc_id", folds: int = 5) -> Column:
    """True for ids outside the held-out fold (crc32 of the id as text, modulo ``folds``, is 0)."""
    return id_crc_mod(id_col, folds) != 0
