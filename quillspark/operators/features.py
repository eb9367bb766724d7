"""Character-gram weights, similarity retrieval, log-odds lexicons and marker rates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T


def one_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s\s+", " ")


def counts(docs: DataFrame, key: str, sizes: tuple[int, ...], lower: bool = True) -> DataFrame:
    """(key, gram, tf): runs of white space count as one space."""
    c = one_space(F.col("text"))
    c = F.lower(c) if lower else c
    return docs.select(key, F.explode(T.grams(c, sizes)).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf"))


def idf(tf: DataFrame, n: int, least: int = 1) -> DataFrame:
    df = tf.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    return df.select("gram", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(tf: DataFrame, key: str, weights: DataFrame) -> DataFrame:
    """(key, gram, w): sublinear tf, smooth idf, unit length."""
    raw = tf.join(weights, "gram").select(key, "gram", ((1 + F.log("tf")) * F.col("idf")).alias("v"))
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return raw.join(norm, key).select(key, "gram", (F.col("v") / F.col("norm")).alias("w"))


def top_similar(queries: DataFrame, q: str, docs: DataFrame, d: str, k: int) -> DataFrame:
    """(q, d, sim, rank) of the k most similar documents of each query; ties by the greater d, nothing in common excluded."""
    sims = queries.withColumnRenamed("w", "wq").join(docs.withColumnRenamed("w", "wd"), "gram").groupBy(q, d).agg(F.round(F.sum(F.col("wq") * F.col("wd")), 6).alias("sim"))
    return sims.withColumn("rank", F.row_number().over(W.partitionBy(q).orderBy(F.desc("sim"), F.desc(d)))).where(F.col("rank") <= k)


def log_odds(rows: DataFrame, term: str, label: str, least: int = 20) -> DataFrame:
    """(term, own, other, score): smoothed log odds of terms with at least `least` uses where label is 0."""
    both = rows.groupBy(term).agg(F.count_if(F.col(label) == 1).alias("own"), F.count_if(F.col(label) == 0).alias("other"))
    total = both.agg(F.sum("own").alias("n_own"), F.sum("other").alias("n_other"))
    score = F.log((F.col("other") + 1) / F.col("n_other")) - F.log((F.col("own") + 1) / F.col("n_own"))
    return both.where(F.col("other") >= least).join(F.broadcast(total)).select(term, "own", "other", score.alias("score"))


def greedy(lexicon: Iterable[str], top: int = 300) -> list[str]:
    """Terms in order, each kept if it neither holds nor lies in one kept."""
    kept: list[str] = []
    for t in lexicon:
        if len(kept) == top:
            break
        if not any(t in x or x in t for x in kept):
            kept.append(t)
    return kept


def script_grams(rows: DataFrame, sizes: tuple[int, ...] = (2, 3, 4), letter: str = "[一-鿿]") -> DataFrame:
    """rows (text, ...) as one row a gram: character grams of letters alone, white space taken out before."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "")
    runs = F.filter(F.split(bare, letter.replace("[", "[^", 1)), lambda x: F.length(x) > 1)
    every = F.flatten(F.transform(runs, lambda r: T.grams(r, sizes)))
    return rows.withColumn("gram", F.explode(every))


def lexicon(rows: DataFrame, top: int = 300, least: int = 20, sizes: tuple[int, ...] = (2, 3, 4), letter: str = "[一-鿿]") -> list[str]:
    """Grams that rows of y 0 use far more than those of y 1, best first, none within another. Read from the top until `top` are found."""
    scored = log_odds(script_grams(rows.select("text", "y"), sizes, letter), "gram", "y", least).orderBy(F.desc("score"), F.desc("gram"))
    return greedy((r.gram for r in scored.select("gram").toLocalIterator()), top)


def marker_rate(docs: DataFrame, markers: list[str], *by: str) -> DataFrame:
    """(by, chars, hits, rate): hits that don't overlap per 1,000 characters, a ratio of sums."""
    text = F.coalesce("text", F.lit(""))
    found = T.total_hits(text, markers)
    out = docs.groupBy(*by).agg(F.sum(F.length(text)).cast("long").alias("chars"), F.sum(found).cast("long").alias("hits"))
    return out.withColumn("rate", F.round(1000.0 * F.col("hits") / F.greatest(F.lit(1), F.col("chars")), 6))


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """(q, d, sim, rank): the k vectors (id, vector) of greatest cosine for each query (id, vector), exact; ties by the lesser d, a query isn't its own neighbour.

    Blocks of queries meet blocks of vectors, a matrix product each, and only the k best of a block travel on.
    """
    import numpy as np
    import pandas as pd

    def packed(frames):
        for f in frames:
            for i in range(0, len(f), block):
                part = f.iloc[i : i + block]
                x = np.stack([np.asarray(v, np.float64) for v in part["vector"]])
                yield pd.DataFrame({"ids": [part["id"].to_numpy(np.int64).tobytes()], "matrix": [x.tobytes()]})

    def blocks(rows: DataFrame) -> DataFrame:
        return rows.select(F.col("id").cast("long").alias("id"), "vector").where("id is not null and size(vector) > 0").mapInPandas(packed, "ids binary, matrix binary")

    def scored(frames):
        for f in frames:
            for q_ids, q_matrix, d_ids, d_matrix in f.itertuples(index=False):
                q, d = np.frombuffer(q_ids, np.int64), np.frombuffer(d_ids, np.int64)
                a, b = np.frombuffer(q_matrix).reshape(len(q), -1), np.frombuffer(d_matrix).reshape(len(d), -1)
                lengths = np.sqrt((a * a).sum(axis=1))[:, None] * np.sqrt((b * b).sum(axis=1))[None, :]
                sim = np.round(a @ b.T / np.maximum(lengths, 1e-300), 6)
                sim[q[:, None] == d[None, :]] = -np.inf
                best = np.lexsort((np.broadcast_to(d, sim.shape), -sim), axis=1)[:, :k]
                rows = pd.DataFrame({"q": np.repeat(q, best.shape[1]), "d": d[best].ravel(), "sim": np.take_along_axis(sim, best, 1).ravel()})
                yield rows[np.isfinite(rows["sim"])]

    pairs = blocks(queries).toDF("q_ids", "q_matrix").crossJoin(blocks(vectors).toDF("d_ids", "d_matrix"))
    found = pairs.mapInPandas(scored, "q long, d long, sim double")
    by = W.partitionBy("q").orderBy(F.desc("sim"), "d")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
