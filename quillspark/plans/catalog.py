"""The registered queries of the engine over the driver's tables, each beside SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions import udx
from quillspark.functions.profiles import LATIN
from quillspark.operators import articles, corpus, detector, features, metrics, pairs, rewriting, similar
from quillspark.sources import files

MARKERS = ["tion", "ement", "heit", "ción", "the"]
PAGE = (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"<[^>]+>")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query; without SQL it is one that tests hold against a plain form."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


LINES = r"""p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '[A-Za-zÀ-ÿ]')) AS ls FROM documents),
lines AS (SELECT doc_id, i - 1 AS idx, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM p))"""


@query(f"WITH {LINES} SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(length(text) AS BIGINT) AS chars, md5(text) AS digest FROM lines")
def paragraph_explode(t):
    u = corpus.units(t("documents"), "doc_id", LATIN)
    return u.select("doc_id", F.col("idx").cast("long").alias("idx"), F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))


@query(f"WITH {LINES} SELECT doc_id, CAST(idx AS BIGINT) AS idx, md5(text) AS digest, md5(coalesce(lag(text) OVER (PARTITION BY doc_id ORDER BY idx), '')) AS prev FROM lines")
def unit_prev_lag(t):
    u = corpus.units(t("documents"), "doc_id", LATIN)
    return u.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("digest"), F.md5("prev").alias("prev"))


@query("""SELECT reason, count(*) AS posts FROM (SELECT CASE WHEN source IN ('src3', 'src7') THEN 'slug' WHEN lang IN ('de') THEN 'tag' WHEN n_chars < 200 THEN 'too_short' END AS reason FROM documents)
WHERE reason IS NOT NULL GROUP BY reason""")
def exclusion_reasons(t):
    rules = {"slug": F.col("source").isin("src3", "src7"), "tag": F.col("lang") == "de", "too_short": F.col("n_chars") < 200}
    return t("documents").select(corpus.exclusion_reason(rules).alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("posts"))


SPLIT = """s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total FROM documents),
split AS (SELECT doc_id, source, CASE WHEN k <= a THEN 'test' WHEN k <= a + b THEN 'val' ELSE 'train' END AS split FROM (
  SELECT *, least(greatest(1, CAST(round_even(20 * n / total, 0) AS BIGINT)), n - 1) AS a, CAST(round_even(10 * n / total, 0) AS BIGINT) AS b FROM s))"""


@query(f"WITH {SPLIT} SELECT doc_id, source, split FROM split")
def split_assign(t):
    return corpus.splits(t("documents").select("doc_id", "source"), "doc_id", "source", seed=42)


@query(f"WITH {SPLIT} SELECT split, count(DISTINCT source) AS buckets, count(*) AS posts FROM split GROUP BY split")
def split_report(t):
    return corpus.split_report(corpus.splits(t("documents").select("doc_id", "source"), "doc_id", "source", seed=42), "source")


@query(f"WITH {LINES} SELECT doc_id, count(lines.text) AS units, CAST(coalesce(sum(length(lines.text)), 0) AS BIGINT) AS chars FROM documents LEFT JOIN lines USING (doc_id) GROUP BY doc_id")
def post_units(t):
    parts = T.paragraphs(F.col("text"), LATIN)
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return t("documents").select("doc_id", F.size(parts).cast("long").alias("units"), total.alias("chars"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'))), ' ') AS raw,
array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?'), lambda x: printf('%.5e', CAST(replace(x, ',', '') AS DOUBLE))))), ' ') AS canonical
FROM documents WHERE regexp_matches(text, '[0-9]')""")
def number_sets(t):
    show = lambda c: F.array_join(F.sort_array(c), " ")
    return t("documents").where(F.col("text").rlike("[0-9]")).select("doc_id", show(T.numbers(F.col("text"))).alias("raw"), show(T.number_values(F.col("text"))).alias("canonical"))


@query(r"""SELECT conv_id, turn, CAST(len(x) AS BIGINT) AS n, md5(array_to_string(x, ' ')) AS digest FROM (SELECT conv_id, turn,
list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9+\-.]*'), lambda w: regexp_replace(lower(w), '^[.-]+|[.-]+$', '', 'g')))) AS x FROM conversations)""")
def latin_tokens(t):
    x = F.sort_array(T.tokens(F.col("text")))
    return t("conversations").select("conv_id", "turn", F.size(x).cast("long").alias("n"), F.md5(F.array_join(x, " ")).alias("digest"))


def derived(t) -> DataFrame:
    """Each document with a rewrite of one of five kinds: copied, cut, digits moved, two words added, empty."""
    c = F.col("text")
    kind = F.pmod("doc_id", F.lit(5))
    new = F.when(kind == 0, c).when(kind == 1, F.left(c, F.floor(F.length(c) / 3).cast("int"))).when(kind == 2, F.translate(c, "0123456789", "1234567890"))
    return t("documents").select("doc_id", "lang", "source", c.alias("original"), new.when(kind == 3, F.concat(c, F.lit(" Zyxware Qvortex"))).otherwise("").alias("rewrite"))


DERIVED = """pair AS (SELECT doc_id, lang, source, text AS original, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN left(text, CAST(length(text) // 3 AS BIGINT)) WHEN 2 THEN translate(text, '0123456789', '1234567890')
WHEN 3 THEN text || ' Zyxware Qvortex' ELSE '' END AS rewrite FROM documents)"""
_TOK = r"list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z0-9+\-.]*'), lambda w: regexp_replace(lower(w), '^[.-]+|[.-]+$', '', 'g')))"
_NUM = r"list_distinct(regexp_extract_all({}, '[0-9]+(?:\.[0-9]+)?'))"
GATE = rf"""{DERIVED}, f AS (SELECT *, length(rewrite) / greatest(1, length(original)) AS ratio, {_NUM.format('original')} AS na, {_NUM.format('rewrite')} AS nb, {_TOK.format('original')} AS ta, {_TOK.format('rewrite')} AS tb FROM pair),
gate AS (SELECT doc_id, lang, CASE WHEN trim(rewrite) = '' THEN 'empty' WHEN ratio NOT BETWEEN 0.5 AND 1.9 THEN 'length_ratio'
  WHEN len(list_filter(na, lambda x: NOT list_contains(nb, x))) + len(list_filter(nb, lambda x: NOT list_contains(na, x))) > 0 THEN 'number_changed'
  WHEN len(list_filter(list_filter(tb, lambda w: NOT list_contains(ta, w)), lambda w: len(list_filter(ta, lambda x: contains(x, w) OR contains(w, x))) = 0)) > 1 THEN 'latin_invented' ELSE 'ok' END AS why FROM f)"""


@query(f"WITH {GATE} SELECT doc_id, why = 'ok' AS ok, why FROM gate")
def pair_gate(t):
    return pairs.gate(derived(t), profile=LATIN).select("doc_id", (F.col("why") == "ok").alias("ok"), "why")


@query(f"WITH {GATE} SELECT lang, why, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM gate GROUP BY lang, why")
def gate_reasons(t):
    n = pairs.gate(derived(t), profile=LATIN).groupBy("lang", "why").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("lang")), 6))


_VAL = r"list_distinct(list_transform(regexp_extract_all({}, '[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?'), lambda x: printf('%.5e', CAST(replace(x, ',', '') AS DOUBLE))))"
GUARD = rf"""{DERIVED}, f AS (SELECT doc_id, source, original, rewrite, length(rewrite) / greatest(1, length(original)) AS ratio, {_VAL.format('original')} AS a, {_VAL.format('rewrite')} AS b FROM pair),
y AS (SELECT *, list_filter(a, lambda x: NOT list_contains(b, x) AND NOT (CAST(x AS DOUBLE) BETWEEN 0 AND 99.99999 AND list_contains(b, printf('%.5e', CAST(x AS DOUBLE) + 2000)))
  AND NOT (CAST(x AS DOUBLE) >= 2000 AND CAST(x AS DOUBLE) < 2100 AND list_contains(b, printf('%.5e', CAST(x AS DOUBLE) - 2000)))) AS lost,
  list_filter(b, lambda x: NOT list_contains(a, x) AND NOT (CAST(x AS DOUBLE) BETWEEN 0 AND 99.99999 AND list_contains(a, printf('%.5e', CAST(x AS DOUBLE) + 2000)))
  AND NOT (CAST(x AS DOUBLE) >= 2000 AND CAST(x AS DOUBLE) < 2100 AND list_contains(a, printf('%.5e', CAST(x AS DOUBLE) - 2000)))) AS new FROM f),
guard AS (SELECT doc_id, source, original, rewrite, ratio, CASE WHEN ratio NOT BETWEEN 0.6 AND 1.6 THEN printf('length_ratio %.2f', CAST(ratio AS DOUBLE)) WHEN len(lost) + len(new) > 0 THEN 'number_changed' END AS reason, len(lost) + len(new) > 0 AS drift FROM y)"""


@query(f"WITH {GUARD} SELECT doc_id, reason FROM guard")
def paragraph_guard(t):
    return pairs.guard(derived(t), profile=LATIN).select("doc_id", "reason")


@query(f"WITH {GUARD} SELECT source, round(avg(drift::INT), 6) AS number_err, round(avg((ratio NOT BETWEEN 0.6 AND 1.6)::INT), 6) AS rejected, median(CAST(ratio AS DOUBLE)) AS len_ratio FROM guard GROUP BY source")
def scorecard(t):
    ratio = F.length("rewrite") / F.greatest(F.lit(1), F.length("original"))
    rows = derived(t).select("source", ratio.alias("ratio"), (F.size(T.number_drift(F.col("original"), F.col("rewrite"), LATIN)) > 0).cast("int").alias("drift"))
    return rows.groupBy("source").agg(F.round(F.avg("drift"), 6).alias("number_err"), F.round(F.avg((~F.col("ratio").between(0.6, 1.6)).cast("int")), 6).alias("rejected"), F.median("ratio").alias("len_ratio"))


@query("""SELECT u.user_id, p.prompt_id FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (VALUES ('view'), ('purchase'), ('refund')) p(prompt_id)
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = p.prompt_id AND e.value > 20)""")
def pending_jobs(t):
    done = t("events").where("value > 20").select("user_id", F.col("event_type").alias("prompt_id"))
    return pairs.pending(t("events"), "user_id", ("view", "purchase", "refund"), done)


@query("SELECT user_id, event_type, event_id, value FROM events WHERE event_type <> 'error' QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedupe_first(t):
    return pairs.first_wins(t("events").where("event_type <> 'error'"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, prompt_id, event_id FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN event_type || '@b' ELSE event_type END AS prompt_id, event_type FROM events WHERE event_type <> 'error')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY contains(prompt_id, '@'), CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 99 END, event_id) = 1""")
def eval_pick(t):
    prompt = F.when(F.col("event_id") % 3 == 0, F.concat("event_type", F.lit("@b"))).otherwise(F.col("event_type"))
    rows = t("events").where("event_type <> 'error'").select("user_id", "event_id", prompt.alias("prompt_id"))
    return pairs.preferred(rows, "user_id", "prompt_id", ["purchase", "signup"], "event_id")


@query(f"""WITH {GATE}, ex AS (SELECT gate.doc_id || '#' || why AS unit_id, pair.rewrite AS q, pair.original AS a FROM gate JOIN pair USING (doc_id) WHERE why = 'ok'
UNION ALL SELECT doc_id || '#identity', text, text FROM documents WHERE n_chars < 500)
SELECT unit_id, md5('Rewrite.' || chr(10) || chr(10) || '【要改写的段落】' || chr(10) || q) AS question, md5(a) AS answer FROM ex""")
def sft_examples(t):
    good = pairs.gate(derived(t), profile=LATIN).where("why = 'ok'").select(F.concat_ws("#", "doc_id", "why").alias("unit_id"), F.lit("").alias("prev"), F.col("rewrite").alias("input"), F.col("original").alias("text"))
    same = t("documents").where("n_chars < 500").select(F.concat_ws("#", "doc_id", F.lit("identity")).alias("unit_id"), F.lit("").alias("prev"), F.col("text").alias("input"), "text")
    m = pairs.examples(good.unionByName(same), "Rewrite.")
    return m.select("unit_id", F.md5(F.col("messages")[0]["content"]).alias("question"), F.md5(F.col("messages")[1]["content"]).alias("answer"))


def _tf(name: str, key: str) -> str:
    return rf"""{name}_c AS (SELECT {key}, string_split(lower(regexp_replace(text, '\s\s+', ' ', 'g')), '') AS c FROM {name}),
{name}_i AS (SELECT {key}, c, unnest(range(1, len(c) + 1)) AS i, len(c) AS n FROM {name}_c WHERE len(c) > 0),
{name}_g AS (SELECT {key}, c[i] || c[i + 1] AS gram FROM {name}_i WHERE i < n UNION ALL SELECT {key}, c[i] || c[i + 1] || c[i + 2] FROM {name}_i WHERE i < n - 1),
{name}_tf AS (SELECT {key}, gram, count(*) AS tf FROM {name}_g GROUP BY ALL)"""


_WEIGHT = "{t}_v AS (SELECT {k}, gram, (1 + ln(tf)) * idf AS v FROM {t}_tf JOIN idf USING (gram)), {t}_w AS (SELECT {k}, gram, v / sqrt(sum(v * v) OVER (PARTITION BY {k})) AS w FROM {t}_v)"


@query(f"""WITH {_tf('benchmark', 'item_id')}, idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM benchmark_tf GROUP BY gram), {_WEIGHT.format(t='benchmark', k='item_id')}
SELECT item_id, gram, round(w, 6) AS w FROM benchmark_w""")
def char_tfidf(t):
    tf = features.counts(t("benchmark"), "item_id", (2, 3))
    return features.tfidf(tf, "item_id", features.idf(tf, t("benchmark").count())).select("item_id", "gram", F.round("w", 6).alias("w"))


@query(f"""WITH {_tf('benchmark', 'item_id')}, {_tf('documents', 'doc_id')}, idf AS (SELECT gram, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM documents_tf GROUP BY gram),
{_WEIGHT.format(t='benchmark', k='item_id')}, {_WEIGHT.format(t='documents', k='doc_id')},
sim AS (SELECT item_id, doc_id, round(sum(a.w * b.w), 6) AS sim FROM benchmark_w a JOIN documents_w b USING (gram) GROUP BY ALL)
SELECT item_id, sim, CAST(row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, doc_id DESC) AS BIGINT) AS rank FROM sim QUALIFY rank <= 8""")
def retrieve_topk(t):
    found = similar.top_similar(t("benchmark").select("item_id", "text"), "item_id", t("documents").select("doc_id", "text"), "doc_id", 8)
    return found.select("item_id", "sim", F.col("rank").cast("long").alias("rank"))


_WORDS = r"w AS (SELECT doc_id, source, quality, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS term FROM documents JOIN labels USING (doc_id))"
_ODDS = f"""{_WORDS}, k AS (SELECT term, count_if(quality = 1) AS own, count_if(quality = 0) AS other FROM w GROUP BY term),
odds AS (SELECT term, own, other, ln((other + 1) / (SELECT sum(other) FROM k)) - ln((own + 1) / (SELECT sum(own) FROM k)) AS score FROM k WHERE other >= 20)"""


def labelled_words(t) -> DataFrame:
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0))).alias("term")
    return t("documents").join(t("labels").select("doc_id", "quality"), "doc_id").select("doc_id", "source", "quality", words)


@query(f"WITH {_ODDS} SELECT term, own, other, round(score, 6) AS score FROM odds")
def marker_lexicon(t):
    return features.log_odds(labelled_words(t), "term", "quality").withColumn("score", F.round("score", 6))


_SCORED = f"""{_ODDS}, scored AS (SELECT doc_id, source, any_value(quality) AS y, count(*) AS words, round(1 / (1 + exp(sum(coalesce(score, 0)) / count(*))), 6) AS p FROM w LEFT JOIN odds USING (term) GROUP BY doc_id, source)"""


def scored(t) -> DataFrame:
    words = labelled_words(t)
    weights = features.log_odds(words, "term", "quality").select("term", "score")
    z = F.sum(F.coalesce("score", F.lit(0.0))) / F.count("*")
    return words.join(weights, "term", "left").groupBy("doc_id", "source").agg(F.first("quality").alias("y"), F.count("*").alias("words"), F.round(1 / (1 + F.exp(z)), 6).alias("p"))


@query(f"""WITH {_SCORED} SELECT source, round(p, 5) AS p, CASE WHEN p < 0.3 THEN 1 WHEN p < 0.5 THEN 2 WHEN p < 0.85 THEN 3 ELSE 4 END AS band, docs FROM
(SELECT source, sum(p * words) / sum(words) AS p, count(*) AS docs FROM scored GROUP BY source)""")
def classifier_score(t):
    p = scored(t).groupBy("source").agg((F.sum(F.col("p") * F.col("words")) / F.sum("words")).alias("p"), F.count("*").alias("docs"))
    return p.select("source", F.round("p", 5).alias("p"), T.band(F.col("p")).alias("band"), "docs")


@query(f"WITH {_SCORED} SELECT source, doc_id, p, CAST(k AS BIGINT) AS k FROM (SELECT source, doc_id, p, row_number() OVER (PARTITION BY source ORDER BY p, doc_id) AS k FROM scored) WHERE k <= 3")
def worst_k(t):
    k = F.row_number().over(W.partitionBy("source").orderBy("p", "doc_id"))
    return scored(t).select("source", "doc_id", "p", k.cast("long").alias("k")).where("k <= 3")


def _auc(rows: str, by: str) -> str:
    g = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""ranked AS (SELECT *, rank() OVER ({part} ORDER BY p) + (count(*) OVER (PARTITION BY {g}p) - 1) / 2 AS rk FROM {rows})
SELECT {g}count_if(y = 1) AS n_pos, count_if(y = 0) AS n_neg, round((sum(rk) FILTER (WHERE y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2) / (count_if(y = 1) * count_if(y = 0)), 6) AS auc,
round(avg(p) FILTER (WHERE y = 1), 6) AS mean_pos, round(avg(p) FILTER (WHERE y = 0), 6) AS mean_neg, round(avg((p > 0.5)::INT) FILTER (WHERE y = 1), 6) AS pos_above, round(avg((p < 0.5)::INT) FILTER (WHERE y = 0), 6) AS neg_below
FROM ranked {f'GROUP BY {by}' if by else ''} HAVING count_if(y = 1) > 0 AND count_if(y = 0) > 0"""


@query(f"WITH l AS (SELECT quality AS y, round(n_chars / 10000, 6) AS p FROM documents JOIN labels USING (doc_id)), {_auc('l', '')}")
def separation_auc(t):
    rows = t("documents").join(t("labels"), "doc_id").select(F.col("quality").alias("y"), F.round(F.col("n_chars") / 10000, 6).alias("p"))
    return metrics.separation(rows)


_SLICES = """l AS (SELECT quality AS y, round((doc_id * 7919 % 1000) / 1000, 6) AS p, lang, CASE WHEN n_chars < 800 THEN '0-800' WHEN n_chars < 2000 THEN '800-2000' ELSE '2000+' END AS b FROM documents JOIN labels USING (doc_id)),
s AS (SELECT 'all' AS slice, y, p FROM l UNION ALL SELECT 'lang:' || lang, y, p FROM l UNION ALL SELECT 'length:' || b, y, p FROM l)"""


@query(f"WITH {_SLICES}, {_auc('s', 'slice')}")
def separation_slices(t):
    bucket = F.when(F.col("n_chars") < 800, "0-800").when(F.col("n_chars") < 2000, "800-2000").otherwise("2000+")
    keys = F.array(F.lit("all"), F.concat(F.lit("lang:"), "lang"), F.concat(F.lit("length:"), bucket))
    rows = t("documents").join(t("labels"), "doc_id").select(F.explode(keys).alias("slice"), F.col("quality").alias("y"), F.round((F.col("doc_id") * 7919 % 1000) / 1000, 6).alias("p"))
    return metrics.separation(rows, "slice")


_RATE = " + ".join(f"(length(text) - length(replace(text, '{m}', ''))) / {len(m)}" for m in MARKERS)


@query(f"SELECT source, chars, hits, round(1000.0::DOUBLE * hits / greatest(1, chars), 6) AS rate FROM (SELECT source, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({_RATE}) AS BIGINT) AS hits FROM documents GROUP BY source)")
def marker_rate_by_source(t):
    return features.marker_rate(t("documents"), MARKERS, "source").orderBy(F.desc("rate"), "source")


@query(f"""WITH {LINES}, s AS (SELECT *, round(1 / (1 + h), 6) AS p FROM (SELECT doc_id, idx, text, {_RATE} AS h FROM lines WHERE length(text) >= 20)),
a AS (SELECT doc_id, round(sum(p * length(text)) / sum(length(text)), 6) AS p_author, round(1000.0::DOUBLE * sum(h) / sum(length(text)), 6) AS marker_rate, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS chars,
md5(array_to_string(list_slice(list(text ORDER BY p, idx), 1, 3), '|')) AS worst FROM s GROUP BY doc_id)
SELECT *, CASE WHEN p_author < 0.3 THEN 1 WHEN p_author < 0.5 THEN 2 WHEN p_author < 0.85 THEN 3 ELSE 4 END AS band FROM a""")
def article_scores(t):
    rows = corpus.units(t("documents"), "doc_id", LATIN).where(F.length("text") >= 20)
    found = sum((T.hits(F.col("text"), F.lit(m)) for m in MARKERS), F.lit(0.0))
    out = detector.summary(rows.select("doc_id", "idx", "text", F.round(1 / (1 + found), 6).alias("p")), "doc_id", tuple(MARKERS))
    return out.withColumn("worst", F.md5(F.array_join(F.transform("worst", lambda w: w["text"]), "|")))


@query("""WITH s AS (SELECT label AS step, round(avg(embedding[1]), 6) AS val_loss, round(avg(embedding[2]), 6) AS chrf, round(avg(embedding[3]) + 0.5, 6) AS p FROM embeddings GROUP BY label)
SELECT step, val_loss, chrf FROM s ORDER BY p > 0.53, val_loss NULLS LAST, chrf DESC, step LIMIT 1""")
def checkpoint_pick(t):
    e = F.col("embedding")
    s = t("embeddings").groupBy(F.col("label").alias("step")).agg(F.round(F.avg(e[0].cast("double")), 6).alias("val_loss"), F.round(F.avg(e[1].cast("double")), 6).alias("chrf"), F.round(F.avg(e[2].cast("double")) + 0.5, 6).alias("p"))
    s = s.withColumns({"rate": F.lit(1.0), "err": F.lit(0.0)}).withColumn("flags", metrics.flags())
    return metrics.recommend(s).select("step", "val_loss", "chrf")


@query("""WITH a AS (SELECT lang, count(*) AS n, CAST(count_if(quality = 1) AS BIGINT) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang),
c AS (SELECT lang, n, k, unnest(range(k, n + 1)) AS i FROM a)
SELECT lang, n, k, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) + 1e-9, 4) AS tail FROM c GROUP BY lang, n, k""")
def blind_score(t):
    # the nudge settles ties of rounding, which small powers of 1/2 often are
    a = t("documents").join(t("labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("k"))
    return a.select("lang", "n", "k", F.round(metrics.binomial_tail(F.col("k").cast("int"), F.col("n").cast("int")) + 1e-9, 4).alias("tail"))


@query(r"""WITH l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
f AS (SELECT *, regexp_matches(line, '^\s*```') AS fence, count_if(regexp_matches(line, '^\s*```')) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l),
k AS (SELECT *, CASE WHEN fence OR n % 2 = 1 THEN 'code' || ((n + 1) // 2) WHEN NOT regexp_matches(line, '\S') THEN NULL WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' || i
  WHEN regexp_matches(line, '^\s*>') THEN 'quote' WHEN regexp_matches(line, '^\s*\|') THEN 'table' ELSE 'text' END AS label FROM f),
s AS (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k),
b AS (SELECT *, count_if(i = 1 OR before IS DISTINCT FROM label) OVER (PARTITION BY doc_id ORDER BY i) AS blk FROM s),
g AS (SELECT doc_id, blk, string_agg(line, chr(10) ORDER BY i) AS x, arg_min(before IS NOT NULL, i) AS tight FROM b WHERE label IS NOT NULL GROUP BY doc_id, blk)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY blk) - 1 AS idx, md5(x) AS digest, tight,
  NOT regexp_matches(x, '^\s*(#|!|\||>|<|---|\*\*\*|```)') AND regexp_matches(x, '[A-Za-zÀ-ÿ]') AS prose FROM g""")
def markdown_blocks(t):
    b = articles.block_rows(t("documents"), "doc_id", letter=LATIN.letter)
    return b.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("digest"), "tight", "prose")


_CLEANED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '(?s)```.*?```', chr(10) || chr(10), 'g'),
 '(?is)<script\b.*?</script>', chr(10) || chr(10), 'g'), '(?is)<style\b.*?</style>', chr(10) || chr(10), 'g'), '(?is)<iframe\b.*?</iframe>', chr(10) || chr(10), 'g'), '(?is)<video\b.*?</video>', chr(10) || chr(10), 'g'), '(?is)<audio\b.*?</audio>', chr(10) || chr(10), 'g'),
 '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', '', 'g')"""
_PROSE = r"""list_filter(list_transform(list_filter(string_split({c}, chr(10)), lambda x: NOT regexp_matches(x, '^\s*(#{{1,6}}\s|\|.*\|\s*$|>|([-*_]\s*){{3,}}$)')), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '[A-Za-zÀ-ÿ]'))"""
_UNIT_ROWS = "SELECT doc_id, CAST(idx AS BIGINT) AS idx, md5(x) AS digest, md5(coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY idx), '')) AS prev FROM "


@query(f"""WITH RECURSIVE p AS (SELECT doc_id, {_PROSE.format(c=_CLEANED.format(c='text'))} AS ls FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, ls, 0 AS i, CAST([] AS VARCHAR[]) AS units, CAST(NULL AS VARCHAR) AS held FROM p
  UNION ALL SELECT doc_id, ls, i + 1, CASE WHEN length(w) >= 50 THEN list_append(units, w) ELSE units END, CASE WHEN length(w) < 50 THEN w END
  FROM (SELECT *, CASE WHEN held IS NULL THEN ls[i + 1] ELSE held || chr(10) || chr(10) || ls[i + 1] END AS w FROM f WHERE i < len(ls))),
e AS (SELECT doc_id, CASE WHEN held IS NULL THEN units WHEN len(units) = 0 THEN [held] ELSE list_append(units[1:len(units) - 1], units[len(units)] || chr(10) || chr(10) || held) END AS us FROM f WHERE i = len(ls)),
n AS (SELECT doc_id, i - 1 AS idx, us[i] AS x FROM (SELECT doc_id, us, unnest(range(1, len(us) + 1)) AS i FROM e)) {_UNIT_ROWS} n""")
def merged_units(t):
    # splitting of long units is recursive on its own; split_pieces has it
    u = articles.merged_units(t("documents"), "doc_id", most=10**9, profile=LATIN)
    return u.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("digest"), F.md5("prev").alias("prev"))


@query(rf"""WITH RECURSIVE c AS (SELECT doc_id, unnest(range(1, len(cs) + 1)) AS c, cs FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(chr(10) || text, '\n([ \t]*#{{1,6}}\s)', chr(1) || '\1', 'g'), chr(1)) AS cs FROM documents WHERE text IS NOT NULL)),
p AS (SELECT doc_id, c, unnest(range(1, len(ls) + 1)) AS i, ls, len(ls) AS n FROM (SELECT doc_id, c, {_PROSE.format(c=_CLEANED.format(c='cs[c]'))} AS ls FROM c)),
f AS (SELECT doc_id, c, i, n, ls, 0 AS w, length(ls[1]) AS held, 1 AS k FROM p WHERE i = 1
  UNION ALL SELECT doc_id, c, i + 1, n, ls, CASE WHEN done THEN w + 1 ELSE w END, CASE WHEN done THEN 0 ELSE held END + length(ls[i + 1]), CASE WHEN done THEN 1 ELSE k + 1 END FROM (SELECT *, held >= 900 OR k >= 6 AS done FROM f WHERE i < n)),
z AS (SELECT doc_id, c, w AS lastw, w > 0 AND held < 300 AND k < 6 AS joins FROM f WHERE i = n),
g AS (SELECT f.doc_id, f.c, CASE WHEN joins AND w = lastw THEN w - 1 ELSE w END AS w, string_agg(ls[i], chr(10) || chr(10) ORDER BY i) AS x FROM f JOIN z ON f.doc_id = z.doc_id AND f.c = z.c GROUP BY ALL),
n AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY c, w) - 1 AS idx, x FROM g) {_UNIT_ROWS} n""")
def section_units(t):
    u = articles.section_units(t("documents"), "doc_id", profile=LATIN)
    return u.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("digest"), F.md5("prev").alias("prev"))


@query(None)
def split_pieces(t):
    """Units of at most 120 characters, where a sentence ends within; tests hold it against a plain form."""
    u = articles.merged_units(t("documents"), "doc_id", most=120, profile=LATIN)
    return u.select("doc_id", F.col("idx").cast("long").alias("idx"), F.md5("text").alias("digest"), F.md5("prev").alias("prev"))


_BLOCKS = r"""l AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
f AS (SELECT *, regexp_matches(line, '^\s*```') AS fence, count_if(regexp_matches(line, '^\s*```')) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l),
k AS (SELECT *, CASE WHEN fence OR n % 2 = 1 THEN 'code' || ((n + 1) // 2) WHEN NOT regexp_matches(line, '\S') THEN NULL WHEN regexp_matches(line, '^#{1,6}\s') THEN 'heading' || i
  WHEN regexp_matches(line, '^\s*>') THEN 'quote' WHEN regexp_matches(line, '^\s*\|') THEN 'table' ELSE 'text' END AS label FROM f),
s AS (SELECT *, lag(label) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k),
b AS (SELECT *, count_if(i = 1 OR before IS DISTINCT FROM label) OVER (PARTITION BY doc_id ORDER BY i) AS blk FROM s),
g AS (SELECT doc_id, blk, string_agg(line, chr(10) ORDER BY i) AS x, arg_min(before IS NOT NULL, i) AS tight FROM b WHERE label IS NOT NULL GROUP BY doc_id, blk),
blocks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY blk) - 1 AS idx, x, tight, NOT regexp_matches(x, '^\s*(#|!|\||>|<|---|\*\*\*|```)') AND regexp_matches(x, '[A-Za-zÀ-ÿ]') AS prose FROM g)"""


@query(f"WITH {_BLOCKS} SELECT doc_id, md5(string_agg(CASE WHEN idx = 0 THEN '' WHEN tight THEN chr(10) ELSE chr(10) || chr(10) END || x, '' ORDER BY idx) || chr(10)) AS markdown FROM blocks GROUP BY doc_id")
def rejoined_blocks(t):
    rows = articles.block_rows(t("documents"), "doc_id", letter=LATIN.letter).withColumn("output", F.col("text"))
    return articles.rejoined(rows, "doc_id").select("doc_id", F.md5("markdown").alias("markdown"))


def shouted(text: str, before: str) -> str:
    """Stands for a model: it is right about most paragraphs, and drops half of those that hold a `q`."""
    return text[: len(text) // 2] if "q" in text else text.replace("the", "THE")


@query(f"""WITH {_BLOCKS}, r AS (SELECT doc_id, idx, tight, CASE WHEN prose AND NOT contains(x, 'q') THEN replace(x, 'the', 'THE') ELSE x END AS y, prose, prose AND contains(x, 'q') AND length(x) > 1 AS back FROM blocks)
SELECT doc_id, md5(string_agg(CASE WHEN idx = 0 THEN '' WHEN tight THEN chr(10) ELSE chr(10) || chr(10) END || y, '' ORDER BY idx) || chr(10)) AS markdown, count_if(prose)::BIGINT AS groups, count_if(back)::BIGINT AS fallbacks FROM r GROUP BY doc_id""")
def article_rewrites(t):
    made = rewriting.rewritten(t("documents"), "doc_id", shouted, check=rewriting.paragraph_check(profile=LATIN), letter=LATIN.letter)
    back = F.size(F.filter("log", lambda g: g["fallback"].isNotNull()))
    return made.where("size(log) > 0 OR markdown <> '\n'").select("doc_id", F.md5("markdown").alias("markdown"), F.size("log").cast("long").alias("groups"), back.cast("long").alias("fallbacks"))


@query(f"""WITH {_BLOCKS}, y AS (SELECT 'a' AS system UNION ALL SELECT 'b'), x AS (SELECT * FROM blocks CROSS JOIN y)
SELECT doc_id, system, count(*) AS blocks, count_if(prose)::BIGINT AS prose, count_if(prose AND NOT (system = 'b' AND idx = 0))::BIGINT AS covered, count_if(prose AND system = 'b' AND idx = 0)::BIGINT AS uncovered FROM x
WHERE doc_id IN (SELECT doc_id FROM blocks WHERE prose) AND (system = 'a' OR doc_id IN (SELECT doc_id FROM blocks WHERE prose AND idx > 0)) GROUP BY doc_id, system""")
def compare_alignment(t):
    parts = articles.block_rows(t("documents").withColumnRenamed("doc_id", "article"), "article", letter=LATIN.letter)
    own = parts.where("prose").select("article", "idx", F.col("text").alias("output"), F.array("idx").alias("blocks"))
    systems = F.when(F.col("idx") > 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))
    logs = own.select("article", F.explode(systems).alias("system"), "output", "blocks")
    rows = rewriting.aligned(parts, logs)
    return rows.groupBy(F.col("article").alias("doc_id"), "system").agg(F.count("*").alias("blocks"), F.count_if("prose").alias("prose"), F.count_if("first").alias("covered"), F.count_if("uncovered").alias("uncovered"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract(text, '^([A-Za-z]+)', 1) AS w, text FROM documents), e AS (SELECT *, '[' || w || '](http://x/' || doc_id || ')' || substr(text, length(w) + 1) || ' ![i](p)' AS md FROM d WHERE w <> '')
SELECT doc_id, md5(md) AS restored, CAST(0 AS BIGINT) AS appended, CAST(1 AS BIGINT) AS links, md5(text || ' ![i](p)') AS plain FROM e""")
def links_back(t):
    """Links taken out of a text and put back where their anchors stand word for word."""
    w = F.regexp_extract("text", "^([A-Za-z]+)", 1)
    md = F.concat(F.lit("["), w, F.lit("](http://x/"), F.col("doc_id").cast("string"), F.lit(")"), F.substring("text", F.length(w) + 1, F.length("text")), F.lit(" ![i](p)"))
    rows = t("documents").where(w != "").select("doc_id", T.plain(md).alias("plain"), T.links(md).alias("links"))
    rows = rows.select("*", udx.restored_udf()("plain", "links").alias("r"))
    return rows.select("doc_id", F.md5("r.text").alias("restored"), F.col("r.appended").cast("long").alias("appended"), F.size("links").cast("long").alias("links"), F.md5("plain").alias("plain"))


_GRAMS3 = r"""bc AS (SELECT item_id, string_split(regexp_replace(text, '\s\s+', ' ', 'g'), '') AS c FROM benchmark), bi AS (SELECT item_id, c, unnest(range(1, len(c) + 1)) AS i, len(c) AS n FROM bc WHERE len(c) > 0),
bg AS (SELECT item_id, c[i] AS gram FROM bi UNION ALL SELECT item_id, c[i] || c[i + 1] FROM bi WHERE i < n UNION ALL SELECT item_id, c[i] || c[i + 1] || c[i + 2] FROM bi WHERE i < n - 1),
tf AS (SELECT item_id, gram, count(*) AS tf FROM bg GROUP BY ALL), df AS (SELECT gram, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY gram HAVING count(*) >= 2),
wt AS (SELECT gram, idf, (ascii(md5(gram)) % 7 - 3) / 2.0::DOUBLE AS coef FROM df ORDER BY abs(coef) DESC, gram LIMIT 800), v AS (SELECT item_id, gram, (1 + ln(tf)) * idf AS v, coef FROM tf JOIN wt USING (gram)),
z AS (SELECT item_id, sum(v / nn * coef) AS z FROM (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY item_id)) AS nn FROM v) GROUP BY item_id)"""


@query(f"WITH {_GRAMS3} SELECT item_id, round(1 / (1 + exp(-(coalesce(z, 0) + 0.25))), 6) AS p FROM benchmark LEFT JOIN z USING (item_id)")
def detector_scores(t):
    """A detector pruned, saved as a file, loaded again and applied."""
    docs = t("benchmark")
    spark, n = docs.sparkSession, docs.count()
    weights = features.idf(detector.paragraph_grams(docs, "item_id"), n, 2)
    made = detector.Detector("a", weights.withColumn("coef", (F.ascii(F.md5("gram")) % 7 - 3) / 2), 0.25).pruned(800)
    path = f"{files.scratch(spark)}/detector.json"
    made.save(path)
    return detector.load(spark, path).probabilities(docs.select("item_id", "text"), "item_id").select("item_id", F.round("p", 6).alias("p"))


@query(r"""SELECT page_id, md5(x) AS digest, CAST(length(x) AS BIGINT) AS chars FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(
html, '(?is)<script\b.*?</script>', chr(10), 'g'), '(?is)<style\b.*?</style>', chr(10), 'g'), '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]+>', '', 'g') AS x FROM pages)""")
def page_clean(t):
    c = F.col("html")
    for i, pattern in enumerate(PAGE):
        c = F.regexp_replace(c, pattern, "\n" if i < 3 else "")
    return t("pages").select("page_id", F.md5(c).alias("digest"), F.length(c).cast("long").alias("chars"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS q, b.vec_id AS d, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS sim FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT q, sim, CAST(row_number() OVER (PARTITION BY q ORDER BY sim DESC, d) AS BIGINT) AS rank FROM s QUALIFY rank <= 5""")
def embedding_topk(t):
    rows = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return features.nearest(rows, rows.where("id % 50 = 0"), 5).select("q", "sim", F.col("rank").cast("long").alias("rank"))


@query(r"""WITH p AS (SELECT conv_id, turn, role, text, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, NOT regexp_matches(text, '\b(I|my|we)\b') AND regexp_matches(nt, '\b(I|my|we)\b') AS first_person, len(regexp_extract_all(nt, '(?m)^\s*[*-] ')) > len(regexp_extract_all(text, '(?m)^\s*[*-] ')) AS more_lists
FROM p WHERE role = 'user' AND nr = 'assistant'""")
def drift_prechecks(t):
    w = W.partitionBy("conv_id").orderBy("turn")
    p = t("conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("nr"), F.lead("text").over(w).alias("nt")).where("role = 'user' and nr = 'assistant'")
    me, item = r"\b(I|my|we)\b", F.lit(r"(?m)^\s*[*-] ")
    return p.select("conv_id", "turn", (~F.col("text").rlike(me) & F.col("nt").rlike(me)).alias("first_person"), (F.regexp_count("nt", item) > F.regexp_count("text", item)).alias("more_lists"))
