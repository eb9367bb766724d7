"""A detector of an author's hand: character-gram weights fitted, pruned, saved, loaded, and applied to paragraphs and articles."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import articles, features

FORMAT, SIZES = "quillspark-detector/1", (1, 2, 3)
FEATURES = "gram string, idf double, coef double"


def paragraph_grams(docs: DataFrame, key: str) -> DataFrame:
    return features.counts(docs.select(key, T.normalize_marks(F.col("text")).alias("text")), key, SIZES, lower=False)


@dataclass(frozen=True)
class Detector:
    """`weights` (gram, idf, coef) is as large as the vocabulary and stays a table; the rest is small."""

    author: str
    weights: DataFrame
    intercept: float
    lexicon: tuple[str, ...] = ()

    def pruned(self, most: int) -> Detector:
        """The `most` grams of the largest weights; of equal ones the first in order."""
        return replace(self, weights=self.weights.orderBy(F.desc(F.abs("coef")), "gram").limit(most))

    def probabilities(self, docs: DataFrame, key: str) -> DataFrame:
        """(key, p) of every row of docs (key, text), keys being distinct; without a known gram p follows from the intercept alone."""
        w = features.tfidf(paragraph_grams(docs, key), key, self.weights.select("gram", "idf"))
        z = w.join(self.weights.select("gram", "coef"), "gram").groupBy(key).agg(F.sum(F.col("w") * F.col("coef")).alias("z"))
        p = 1 / (1 + F.exp(-(F.coalesce("z", F.lit(0.0)) + self.intercept)))
        return docs.select(key).join(z, key, "left").select(key, p.alias("p"))

    def save(self, path: str, form: str = FORMAT) -> None:
        """One JSON file, written by the driver: as large as the vocabulary, so prune first."""
        rows = self.weights.orderBy("gram").collect()
        text = json.dumps(
            {"format": form, "author": self.author, "lexicon": list(self.lexicon), "vocabulary": {r.gram: i for i, r in enumerate(rows)}, "idf": [r.idf for r in rows], "coef": [r.coef for r in rows], "intercept": self.intercept},
            ensure_ascii=False,
        )
        write_text(self.weights.sparkSession, path, text)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One UTF-8 file in any store that Spark reaches; replaces what was there."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(conf).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def load(spark: SparkSession, path: str, form: str = FORMAT) -> Detector:
    """A saved detector; `form` is the format its file must name."""
    raw = json.loads(spark.read.text(path, wholetext=True).first()[0])
    if raw.get("format") != form:
        raise ValueError(f"{path} isn't a detector of format {form}")
    rows = [(g, float(raw["idf"][i]), float(raw["coef"][i])) for g, i in raw["vocabulary"].items()]
    return Detector(raw["author"], spark.createDataFrame(rows, FEATURES), float(raw["intercept"]), tuple(raw["lexicon"]))


def fit(rows: DataFrame, key: str, author: str, lexicon: tuple[str, ...] = (), least: int = 2, c: float = 4.0, iterations: int = 2000) -> Detector:
    """Fitted on rows (key, text, y): y 1 is the author's. Both sides weigh alike; grams in fewer than `least` texts go.

    The model has a number for every gram and lives on the driver while it is fitted, as any linear model of Spark's.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors, VectorUDT

    spark, n = rows.sparkSession, rows.count()
    own = rows.where("y = 1").count()
    if not 0 < own < n:
        raise ValueError("rows of both sides are needed")
    tf = paragraph_grams(rows, key)
    weights = features.idf(tf, n, least)
    places = weights.withColumn("i", F.row_number().over(W.orderBy("gram")) - 1)
    size = places.count()
    vector = F.udf(lambda items: Vectors.sparse(size, [(x["i"], x["w"]) for x in items or []]), VectorUDT())
    cells = features.tfidf(tf, key, weights).join(places.select("gram", "i"), "gram").groupBy(key).agg(F.collect_list(F.struct("i", "w")).alias("cells"))
    weight = F.when(F.col("y") == 1, n / (2 * own)).otherwise(n / (2 * (n - own)))
    data = rows.select(key, F.col("y").cast("double").alias("y"), weight.alias("weight")).join(cells, key, "left").select("y", "weight", vector("cells").alias("features"))
    model = LogisticRegression(labelCol="y", weightCol="weight", elasticNetParam=0.0, standardization=False, regParam=1 / (c * n), maxIter=iterations, tol=1e-10).fit(data)
    coef = spark.createDataFrame([(i, float(x)) for i, x in enumerate(model.coefficients)], "i int, coef double")
    return Detector(author, places.join(coef, "i").select("gram", "idf", "coef"), float(model.intercept), lexicon)


def prose(docs: DataFrame, key: str, text: str = "text", least: int = 20, letter: str = "[一-鿿]") -> DataFrame:
    """(key, idx, text): prose blocks of at least `least` characters, without links' targets and a fenced header."""
    body = docs.select(key, F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "").alias("text"))
    blocks = articles.block_rows(body, key, letter=letter)
    return blocks.where(F.col("prose") & (F.length("plain") >= least)).select(key, "idx", F.col("plain").alias("text"))


def summary(scored: DataFrame, key: str, lexicon: tuple[str, ...] = (), worst: int = 3, cuts: tuple[float, float, float] = (0.3, 0.5, 0.85)) -> DataFrame:
    """(key, p_author, band, marker_rate, paragraphs, chars, worst) of scored paragraphs (key, idx, text, p).

    p_author weighs paragraphs by length; worst holds the least likely ones, with the lexicon's markers in them.
    """
    size = F.length("text")
    found = T.total_hits(F.col("text"), lexicon)
    item = F.struct("p", "idx", "text")
    low = F.slice(F.array_sort(F.collect_list(item)), 1, worst)
    known = F.array(*map(F.lit, lexicon)) if lexicon else F.array().cast("array<string>")
    marked = F.transform("low", lambda x: F.struct(x["p"].alias("p"), x["text"].alias("text"), F.filter(known, lambda m: F.contains(x["text"], m)).alias("markers")))
    out = scored.groupBy(key).agg(
        F.round(F.sum(F.col("p") * size) / F.sum(size), 6).alias("p_author"), F.sum(found).alias("hits"), F.count("*").alias("paragraphs"), F.sum(size).cast("long").alias("chars"), low.alias("low"),
    )
    rate = F.round(1000.0 * F.col("hits") / F.greatest(F.lit(1), F.col("chars")), 6)
    return out.select(key, "p_author", T.band(F.col("p_author"), cuts).alias("band"), rate.alias("marker_rate"), "paragraphs", "chars", marked.alias("worst"))


def scored_articles(docs: DataFrame, key: str, detector: Detector, least: int = 20, worst: int = 3, letter: str = "[一-鿿]") -> DataFrame:
    """summary() of articles (key, text) by a detector, the least likely to be the author's first. Articles without prose have no row."""
    rows = prose(docs, key, least=least, letter=letter).withColumn("__id", F.struct(key, "idx"))
    p = detector.probabilities(rows.select("__id", "text"), "__id")
    return summary(rows.join(p, "__id"), key, detector.lexicon, worst).orderBy("p_author", key)
