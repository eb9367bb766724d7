"""Quality classifier: hierarchical empirical Bayes over sites.

A logistic regression on measurements of a text gives each document's evidence. Documents are grouped by host
(`source`) and path (`lang` within it, the finest grouping the table has). The rate of good documents of a host is
shrunk towards the global rate, that of a path towards its host's; how strongly follows from how much the rates of
sites differ in this corpus (method of moments), so a site with few documents keeps nearly its parent's rate. A
document's own evidence is left out of its site's sums. Its posterior odds are its evidence's times the path's odds
over the global ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import NO_ID, back, chunks, free, materialize, record
from quillspark.llm.fitting import labelled, logistic, sigmoid

#: Labelled rows to fit on, at most; a document is rejected below CUT; sums of a site count as STRONGEST documents at most.
SAMPLE, CUT = 20_000, 0.5
WEAKEST, STRONGEST = 4.0, 1_000.0
SYMBOLS = [bytes([c]) for c in b"#*$%&|<>"]


def features(body: bytes) -> list[float]:
    words = body.split()
    n, size = max(len(words), 1), max(len(body), 1)
    raw = np.frombuffer(body, np.uint8)
    upper = ((raw >= 65) & (raw <= 90)).sum() + ((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)).sum()
    lines = [x for x in body.split(b"\n") if x.strip()]
    return [
        np.log1p(len(words)), len(words) < 20, size / n / 10, min(sum(map(body.count, SYMBOLS)) / n, 3), min(body.count(b"!") / n, 3),
        upper / size, len(set(words)) / n / max(1e-9, 1 / (1 + n / 2000)) / 2, sum(a == b for a, b in zip(words, words[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1), ((raw >= 48) & (raw <= 57)).sum() / size, (body.count(b".") + body.count(b",")) / n,
    ]


def site(docs: DataFrame, column: str) -> Column:
    """A part of the site; null is a site like any other."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")) if column in docs.columns else F.lit("")


def row_keys(docs: DataFrame) -> list[Column]:
    """What a document is judged by: id, text, host, path."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))), site(docs, "source"), site(docs, "lang")]


def measured(docs: DataFrame) -> DataFrame:
    """(did, th, host, path, x): the measurements of each row; th is a hash of its text."""
    schema = pa.schema([("did", pa.int64()), ("th", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("x", pa.list_(pa.float32()))])

    def run(batches):
        for b in chunks(batches):
            yield record(schema, *(b.column(i) for i in range(4)), [features(x) for x in b.column(4).to_pylist()])

    did, th, host, path = row_keys(docs)
    rows = docs.select(did.alias("did"), th.alias("th"), host.alias("host"), path.alias("path"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    return rows.mapInArrow(run, "did long, th long, host string, path string, x array<float>")


def shrink(total, n, parent, strength):
    return (total + strength * parent) / (n + strength)


def strength(sites: DataFrame, parent: str) -> float:
    """How many documents the parent's rate counts as: from the variance between sites beyond that within them."""
    spread = F.sum(F.col("n") * (F.col("s") / F.col("n") - F.col(parent)) ** 2)
    within = F.sum(F.col("v") / F.col("n"))
    k, n, squares, between, noise = sites.agg(F.count("*"), F.sum("n"), F.sum(F.col("n") ** 2), spread, within).first()
    rate = sites.agg(F.sum("s") / F.sum("n")).first()[0]
    if not n or k < 2 or rate is None:
        return STRONGEST
    extra = max((between - noise) / max(n - squares / n, 1e-9), 1e-9)
    return float(np.clip(rate * (1 - rate) / extra, WEAKEST, STRONGEST))


def posteriors(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(did, th, host, path, evidence, host_rate, path_rate, posterior) of each row; without labels the evidence is neutral."""
    rows = materialize(measured(docs), "measured")
    # at most `sample` rows of eleven numbers
    found = labelled(rows, labels, "quality", sample).select("did", "x", "y").orderBy("did", "y", "x").toPandas()
    if len(found):
        x, y = np.stack(found["x"].to_numpy()).astype(float), found["y"].to_numpy()
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        beta = logistic((x - mean) / scale, y)
        weights, bias = beta[:-1] / scale, float(beta[-1] - (mean / scale) @ beta[:-1])
    else:
        weights, bias = np.zeros(11), 0.0
    logit = sum((F.col("x")[i].cast("double") * float(w) for i, w in enumerate(weights)), F.lit(bias))
    scored = rows.select("did", "th", "host", "path", F.greatest(F.lit(-12.0), F.least(F.lit(12.0), logit)).alias("z"))
    scored = scored.withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    sums = [F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * (1 - F.col("p"))).alias("v")]
    paths = materialize(scored.groupBy("host", "path").agg(*sums), "paths")
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    base = (s + 0.5) / (n + 1) if n else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v")).withColumn("base", F.lit(base))
    by_host = strength(hosts, "base")
    own = paths.join(hosts.select("host", F.col("n").alias("hn"), F.col("s").alias("hs")), "host")
    own = own.withColumn("host_rate", shrink(F.col("hs"), F.col("hn"), F.lit(base), by_host))
    by_path = strength(own, "host_rate")
    # each row's own evidence leaves its site's sums
    joined = scored.join(own.select("host", "path", "n", "s", "hn", "hs"), ["host", "path"])
    host_rate = shrink(F.col("hs") - F.col("p"), F.col("hn") - 1, F.lit(base), by_host)
    path_rate = shrink(F.col("s") - F.col("p"), F.col("n") - 1, F.col("host_rate"), by_path)
    odds = lambda c: F.log(c / (1 - c))
    out = joined.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    final = F.col("z") + odds(F.col("path_rate")) - float(np.log(base / (1 - base)))
    return out.select("did", "th", "host", "path", F.col("p").alias("evidence"), "host_rate", "path_rate", (1 / (1 + F.exp(-final))).alias("posterior"))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, evidence, host_rate, path_rate, posterior, kept), a row for each row of docs; null texts are empty ones."""
    return posteriors(docs, labels).select(back(F.col("did")).alias("doc_id"), "evidence", "host_rate", "path_rate", "posterior", (F.col("posterior") >= CUT).alias("kept"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps. Rows equal in id, text, source and language are judged alike."""
    keys = free(docs.columns, "did", "th", "host", "path")
    kept = posteriors(docs, labels).where(F.col("posterior") >= CUT).select("did", "th", "host", "path").distinct().toDF(*keys)
    own = docs.withColumns(dict(zip(keys, row_keys(docs))))
    return own.join(kept, keys, "left_semi").select(*docs.columns)


__all__ = ["accepted", "features", "posteriors", "quality_report", "sigmoid"]
