"""Toxicity: a classifier chain over categories.

Categories come in order, each predicted by a linear model on the hits of a bounded vocabulary (words and beginnings
of words, chosen by how unevenly toxic and other labelled texts use them) and on the probabilities of the categories
before it. While fitting, those earlier probabilities are out-of-fold predictions, so later models learn from values
as good as the ones they will meet. The table labels toxic or not and names no categories, so KINDS of them are found:
toxic texts are grouped by the terms they use (spherical k-means), `kind_1` being the largest group. The last category
is `toxic` itself, which alone decides.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import back, chunks, keyed, materialize, record
from quillspark.llm.fitting import labelled, logistic, sigmoid

#: Labelled rows to fit on, at most; size of the vocabulary; folds; least probability of a toxic text; groups of toxic texts.
SAMPLE, TERMS, FOLDS, CUT, KINDS = 12_000, 200, 5, 0.5, 3
CHAIN = (*[f"kind_{k}" for k in range(1, KINDS + 1)], "toxic")
BEGINNINGS, KEPT_WORDS, LONG = range(4, 8), 1 << 18, 100
EDGES = ".,;:!?()[]{}<>\"'|*#$%&"


def terms(word: str) -> list[str]:
    """A word without its edges, and its beginnings (marked ^)."""
    word = word.strip(EDGES)
    return [word, *(f"^{word[:k]}" for k in BEGINNINGS if len(word) > k)] if word else []


class Hits(dict):
    """word -> numbers of the vocabulary's terms in it."""

    def __init__(self, vocabulary: tuple[str, ...]):
        self.number = {t: i for i, t in enumerate(vocabulary)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.number[t] for t in terms(word) if t in self.number)
        if len(word) <= LONG:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = found
        return found


@lru_cache(4)
def hits(vocabulary: tuple[str, ...]) -> Hits:
    return Hits(vocabulary)


def counted(body: bytes, table: Hits) -> tuple[list[int], list[float]]:
    """Numbers of the terms that occur; log number of words that have one, and their share."""
    words = body.decode().lower().split()
    found = [h for h in map(table.__getitem__, words) if h]
    return sorted({i for h in found for i in h}), [float(np.log1p(len(found))), len(found) / max(len(words), 1)]


def kinds(x: np.ndarray, k: int = KINDS, rounds: int = 20) -> np.ndarray:
    """Groups 0 .. k - 1 of rows, the largest first, by spherical k-means from rows far from each other."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    if not len(unit):
        return np.zeros(0, int)
    centres = unit.mean(axis=0, keepdims=True)
    for i in range(k):
        centres = np.vstack((centres[1 if not i else 0 :], unit[np.argmin((unit @ centres.T).max(axis=1))]))
    for _ in range(rounds):
        of = np.argmax(unit @ centres.T, axis=1)
        centres = np.stack([unit[of == j].mean(axis=0) if (of == j).any() else centres[j] for j in range(k)])
    order = np.argsort(-np.bincount(of, minlength=k), kind="stable")
    return np.argsort(order)[of]


def vocabulary(rows: DataFrame, size: int) -> tuple[str, ...]:
    """The terms that toxic texts of rows (did, th, body, y) use most unevenly often, by z score."""
    schema = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])

    def run(batches):
        for b in chunks(batches):
            seen = [Counter(), Counter()]
            for body, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                seen[y < 0.5].update({t for w in set(body.decode().lower().split()) for t in terms(w)})
            every = list(seen[0] | seen[1])
            yield record(schema, every, [seen[0][t] for t in every], [seen[1][t] for t in every])

    counts = rows.mapInArrow(run, "term string, toxic long, other long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).where("t >= 3")
    total = rows.agg(F.sum("y"), F.count("*")).first()
    if not total[1] or not total[0]:
        return ()
    t, o = total[0], total[1] - total[0]
    rate = (F.col("t") + F.col("o")) / (t + o)
    z = (F.col("t") / t - F.col("o") / max(o, 1)) / F.sqrt(rate * (1.0001 - rate) * (1 / t + 1 / max(o, 1)))
    return tuple(r.term for r in counts.select("term", z.alias("z")).orderBy(F.desc("z"), "term").limit(size).collect())


def matrix(found: list, amounts: list, size: int) -> np.ndarray:
    x = np.zeros((len(found), size + 2))
    for i, (ids, more) in enumerate(zip(found, amounts)):
        x[i, ids] = 1
        x[i, size:] = more
    return x


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = TERMS, chain: bool = True) -> tuple[tuple[str, ...], list[np.ndarray], dict[str, float]]:
    """(vocabulary, coefficients of each category, held-out accuracy of each); without `chain` the models don't see each other."""
    # at most `sample` rows
    rows = materialize(labelled(keyed(docs.select("doc_id", "text")), labels, "toxic", sample).select("did", "th", "body", "y"), "sample")
    words = vocabulary(rows, size)
    schema = pa.schema([("did", pa.int64()), ("y", pa.float64()), ("ids", pa.list_(pa.int32())), ("amounts", pa.list_(pa.float64()))])

    def run(batches):
        table = hits(words)
        for b in chunks(batches):
            yield record(schema, b.column(0), b.column(3), *map(list, zip(*(counted(x, table) for x in b.column(2).to_pylist()))))

    pdf = rows.mapInArrow(run, "did long, y double, ids array<int>, amounts array<double>").toPandas().sort_values(["did", "y"], kind="stable")
    y = pdf["y"].to_numpy() > 0.5
    x = matrix(pdf["ids"].tolist(), pdf["amounts"].tolist(), len(words))
    of = np.full(len(y), -1)
    of[y] = kinds(x[y, : len(words)])
    aims = [of == k for k in range(KINDS)] + [y]
    fold = pdf["did"].to_numpy() * 2654435761 % 2**32 * FOLDS >> 32
    models, accuracy = [], {}
    for name, aim in zip(CHAIN, aims):
        aim = aim.astype(float)
        held = np.zeros(len(aim))
        for k in range(FOLDS):
            beta = logistic(x[fold != k], aim[fold != k], steps=10)
            held[fold == k] = sigmoid(x[fold == k] @ beta[:-1] + beta[-1])
        models.append(logistic(x, aim, steps=10, empty=0.01))
        accuracy[name] = float(((held >= 0.5) == (aim > 0.5)).mean()) if len(aim) else 1.0
        x = np.column_stack((x, held)) if chain else x
    return words, models, accuracy


def chained(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    columns = []
    for beta in models:
        columns.append(sigmoid(x @ beta[:-1] + beta[-1]))
        x = np.column_stack((x, columns[-1]))
    return np.column_stack(columns)


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, p_<category> ..., toxic) of each row; null texts are empty. Without toxic labels nothing is toxic."""
    words, models, _ = fit(docs, labels)
    names = [f"p_{c}" for c in CHAIN]
    schema = pa.schema([("did", pa.int64()), *((c, pa.float64()) for c in names)])

    def run(batches):
        table = hits(words)
        for b in chunks(batches, 1 << 20):
            found, amounts = zip(*(counted(x, table) for x in b.column(2).to_pylist()))
            yield record(schema, b.column(0), *chained(matrix(found, amounts, len(words)), models).T)

    out = keyed(docs.select("doc_id", "text")).mapInArrow(run, "did long, " + ", ".join(f"{c} double" for c in names))
    return out.select(back(F.col("did")).alias("doc_id"), *names, (F.col("p_toxic") >= CUT).alias("toxic"))
