"""Queries of the dataset builders, files and scores over Han text, each beside SQL written from the rules, not from the code.

The driver's tables hold no Han text, so letters are moved to Han characters, one for one; `三` among them can stand for a 3.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import prompts as P
from quillspark.functions import text as T
from quillspark.functions.profiles import HAN
from quillspark.operators import articles, builders, corpus, features, metrics, pairs
from quillspark.plans.catalog import _auc, query
from quillspark.sources import files

LETTERS, HANS = "abcdefghijklmnopqrstuvwxyz", "的一三在不了有和人这中大为上个国我以要他时来用们生到"
MARKS = ["的", "这人", "三在"]
SPLITS = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'train' END"
PROMPTS = ["formal", "default", "style_mimic@b", "formal", "condense"]
KINDS = """CASE (doc_id + k) % 6 WHEN 0 THEN text WHEN 1 THEN left(text, CAST(length(text) // 3 AS BIGINT)) WHEN 2 THEN text || CASE WHEN doc_id % 2 = 0 THEN ' 3' ELSE ' 9876' END
WHEN 3 THEN text || ' Zyxware Qvortex' WHEN 4 THEN '' ELSE text || '尾' END"""


def units(t) -> DataFrame:
    text = F.translate(F.lower(F.left("text", F.lit(400))), LETTERS, HANS)
    prev = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("前文"), F.col("doc_id").cast("string")))
    return t("documents").select("doc_id", F.concat(F.col("doc_id").cast("string"), F.lit("#000")).alias("unit_id"), text.alias("text"), F.expr(SPLITS).alias("split"), prev.alias("prev"))


def rewrites(t) -> DataFrame:
    rows = units(t).select("doc_id", "unit_id", "text", F.posexplode(F.array(*map(F.lit, PROMPTS))).alias("k", "prompt_id"))
    kind = F.pmod(F.col("doc_id") + F.col("k"), F.lit(6))
    new = (
        F.when(kind == 0, F.col("text")).when(kind == 1, F.left("text", F.floor(F.length("text") / 3).cast("int"))).when(kind == 2, F.concat("text", F.when(F.col("doc_id") % 2 == 0, " 3").otherwise(" 9876")))
        .when(kind == 3, F.concat("text", F.lit(" Zyxware Qvortex"))).when(kind == 4, "").otherwise(F.concat("text", F.lit("尾")))
    )
    unit = F.when((F.col("doc_id") % 97 == 5) & (F.col("k") == 4), "orphan").otherwise(F.col("unit_id"))
    return rows.select(unit.alias("unit_id"), "prompt_id", new.alias("rewrite"), (F.col("doc_id") * 8 + F.col("k")).alias("line_no"))


UNITS = f"""u AS (SELECT doc_id, doc_id || '#000' AS unit_id, translate(lower(left(text, 400)), '{LETTERS}', '{HANS}') AS text, {SPLITS} AS split, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '前文' || doc_id END AS prev FROM documents),
r AS (SELECT CASE WHEN doc_id % 97 = 5 AND k = 4 THEN 'orphan' ELSE unit_id END AS unit_id, prompt_id, {KINDS} AS rewrite, doc_id * 8 + k AS line_no
  FROM u CROSS JOIN (VALUES {', '.join(f"({i}, '{p}')" for i, p in enumerate(PROMPTS))}) p(k, prompt_id))"""
_NUM = r"list_distinct(regexp_extract_all({}, '[0-9]+(?:\.[0-9]+)?'))"
_TOK = r"list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z][A-Za-z0-9+\-.]*'), lambda w: regexp_replace(lower(w), '^[.-]+|[.-]+$', '', 'g')))"
_VAL = r"list_distinct(list_transform(regexp_extract_all({}, '[0-9]{{1,3}}(?:,[0-9]{{3}})+(?:\.[0-9]+)?|[0-9]+(?:\.[0-9]+)?'), lambda x: printf('%.5e', CAST(replace(x, ',', '') AS DOUBLE))))"


def _excused(n: str, other: str) -> str:
    glyphs = {"1": "一", "2": "二两", "3": "三", "4": "四", "5": "五", "6": "六", "7": "七", "8": "八", "9": "九", "10": "十"}
    return "(" + " OR ".join(f"({n} = '{d}' AND regexp_matches({other}, '[{g}]'))" for d, g in glyphs.items()) + ")"


def _gate(rows: str, name: str) -> str:
    """SQL of the pair gate over rows (original, rewrite, ...)."""
    return rf"""{name}_f AS (SELECT *, length(rewrite) / greatest(1, length(original)) AS ratio, {_NUM.format('original')} AS na, {_NUM.format('rewrite')} AS nb, {_TOK.format('original')} AS ta, {_TOK.format('rewrite')} AS tb FROM {rows}),
{name} AS (SELECT *, CASE WHEN trim(rewrite) = '' THEN 'empty' WHEN ratio NOT BETWEEN 0.5 AND 1.9 THEN 'length_ratio'
  WHEN len(list_filter(na, lambda x: NOT list_contains(nb, x) AND NOT {_excused('x', 'rewrite')})) + len(list_filter(nb, lambda x: NOT list_contains(na, x) AND NOT {_excused('x', 'original')})) > 0 THEN 'number_changed'
  WHEN len(list_filter(list_filter(tb, lambda w: NOT list_contains(ta, w)), lambda w: len(list_filter(ta, lambda x: contains(x, w) OR contains(w, x))) = 0)) > 1 THEN 'latin_invented' ELSE 'ok' END AS why FROM {name}_f)"""


_JUDGED = f"""{UNITS}, j AS (SELECT r.unit_id, prompt_id, rewrite, line_no, u.text AS original, prev, split, rewrite <> '' AND u.text IS NOT NULL AS usable FROM r LEFT JOIN u USING (unit_id)),
k AS (SELECT *, usable AND row_number() OVER (PARTITION BY unit_id, prompt_id, usable ORDER BY line_no) = 1 AS first FROM j), kf AS (SELECT * FROM k WHERE first), {_gate('kf', 'g')},
judged AS (SELECT unit_id, prompt_id, rewrite, line_no, original, prev, split, why FROM g UNION ALL SELECT unit_id, prompt_id, rewrite, line_no, original, prev, split, 'missing_or_duplicate' FROM k WHERE NOT first)"""


def judged(t) -> DataFrame:
    return builders.judged(units(t), rewrites(t), builders.builder("paragraph_rewrite"))


@query(f"WITH {_JUDGED} SELECT CASE WHEN why = 'missing_or_duplicate' THEN why ELSE prompt_id || ':' || why END AS reason, count(*) AS n FROM judged GROUP BY 1")
def builder_reasons(t):
    return builders.reasons(judged(t), builders.builder("paragraph_rewrite"))


@query(f"WITH {_JUDGED} SELECT count_if(why <> 'missing_or_duplicate')::BIGINT AS judged, count_if(why = 'ok')::BIGINT AS ok, round(count_if(why = 'ok') / greatest(1, count_if(why <> 'missing_or_duplicate')), 3) AS kept_share FROM judged")
def builder_kept_share(t):
    return builders.kept_share(judged(t))


@query(f"""WITH {_JUDGED} SELECT unit_id, prompt_id, md5(rewrite) AS ai_text, prev, md5(original) AS original FROM judged WHERE why = 'ok' AND split = 'test'
QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY contains(prompt_id, '@'), CASE split_part(prompt_id, '@', 1) WHEN 'style_mimic' THEN 0 WHEN 'default' THEN 1 WHEN 'formal' THEN 2 WHEN 'expand' THEN 3 WHEN 'condense' THEN 4 ELSE 99 END, line_no) = 1""")
def builder_evaluation(t):
    e = builders.evaluation(judged(t), builders.builder("paragraph_rewrite"))
    return e.select("unit_id", "prompt_id", F.md5("ai_text").alias("ai_text"), "prev", F.md5("original").alias("original"))


@query(f"""WITH {_JUDGED}, n AS (SELECT split, CAST(floor(count(*) * 0.05) AS BIGINT) AS n FROM u WHERE split IN ('train', 'val') GROUP BY split),
i AS (SELECT split, unit_id, prev, text, row_number() OVER (PARTITION BY split ORDER BY md5('0|' || unit_id), unit_id) AS k FROM u WHERE split IN ('train', 'val')),
e AS (SELECT split, unit_id, prev, rewrite AS q, original AS a, prompt_id AS kind FROM judged WHERE why = 'ok' AND split IN ('train', 'val') UNION ALL SELECT i.split, unit_id, prev, text, text, '' FROM i JOIN n ON i.split = n.split AND k <= n.n)
SELECT split, unit_id, md5('0|' || unit_id || '|' || kind) AS "order", md5('把下面这段文字改写成作者的文风，内容和顺序不变。' || chr(10) || chr(10) || CASE WHEN prev <> '' THEN '【上文（仅供参考，不要改写）】' || chr(10) || prev || chr(10) || chr(10) ELSE '' END || '【要改写的段落】' || chr(10) || q) AS question, md5(a) AS answer FROM e""")
def builder_examples(t):
    m = builders.training(judged(t), units(t), builders.builder("paragraph_rewrite"), P.instruction())
    return m.select("split", "unit_id", "order", F.md5(F.col("messages")[0]["content"]).alias("question"), F.md5(F.col("messages")[1]["content"]).alias("answer"))


def drafts(t) -> DataFrame:
    """Originals with an enumeration, and drafts that keep it as prose, drop a fact, invent a number, or come from another model."""
    own = units(t).select("doc_id", "unit_id", F.concat("text", F.lit("\n1) 价1,200元 2) 重35公斤")).alias("text"), "split", "prev")
    return own


_DRAFTS = [("draft_formal", "价1200元重35公斤"), ("draft_default@b", "价1200元"), ("draft_default", "价1,200元重35公斤另7天"), ("draft_style", "价1200元重35公斤"), ("extract", "要点")]
# twice, as RE2 can't look around and each match takes the character after it
_UNMARKED = r"regexp_replace({}, '(?m)(^|[\s:：；;。，,])[0-9]{{1,2}}\s*[.)）、]([^0-9]|$)', '\1 \2', 'g')"
_DRAFTED = f"""{UNITS}, o AS (SELECT doc_id, unit_id, text || chr(10) || '1) 价1,200元 2) 重35公斤' AS original, split, prev FROM u),
d AS (SELECT doc_id, unit_id, original, split, prev, prompt_id, CASE WHEN doc_id % 7 = k THEN '' ELSE original_text || tail END AS rewrite, doc_id * 8 + k AS line_no FROM (SELECT o.*, u.text AS original_text FROM o JOIN u USING (unit_id, doc_id, split, prev)) x
  CROSS JOIN (VALUES {', '.join(f"({i}, '{p}', '{x}')" for i, (p, x) in enumerate(_DRAFTS))}) p(k, prompt_id, tail)),
df AS (SELECT *, length(rewrite) / greatest(1, length(original)) AS ratio, {_VAL.format('original')} AS no, {_VAL.format('rewrite')} AS nd,
  {_VAL.format(_UNMARKED.format(_UNMARKED.format('original')))} AS facts, {_TOK.format('original')} AS ta, {_TOK.format('rewrite')} AS tb FROM d WHERE prompt_id <> 'extract' AND rewrite <> ''),
dg AS (SELECT *, CASE WHEN trim(rewrite) = '' THEN 'empty' WHEN ratio NOT BETWEEN 0.6 AND 1.7 THEN 'length_ratio' WHEN len(list_filter(nd, lambda x: NOT list_contains(no, x))) > 0 THEN 'number_invented'
  WHEN len(facts) > 0 AND len(list_filter(facts, lambda x: list_contains(nd, x))) < len(facts) THEN 'numbers_missing'
  WHEN len(list_filter(list_filter(tb, lambda w: NOT list_contains(ta, w)), lambda w: len(list_filter(ta, lambda x: contains(x, w) OR contains(w, x))) = 0)) > 1 THEN 'latin_invented' ELSE 'ok' END AS why FROM df)"""


def drafted(t) -> DataFrame:
    kinds = F.array(*[F.struct(F.lit(p).alias("prompt_id"), F.lit(x).alias("tail")) for p, x in _DRAFTS])
    rows = units(t).select("doc_id", "unit_id", "text", F.posexplode(kinds).alias("k", "d"))
    new = F.when(F.pmod("doc_id", F.lit(7)) == F.col("k"), "").otherwise(F.concat("text", "d.tail"))
    rows = rows.select("unit_id", "d.prompt_id", new.alias("rewrite"), (F.col("doc_id") * 8 + F.col("k")).alias("line_no"))
    return builders.judged(drafts(t), rows, builders.builder("outline_regen", experimental=True))


@query(f"WITH {_DRAFTED} SELECT prompt_id || ':' || why AS reason, count(*) AS n FROM dg GROUP BY 1")
def draft_reasons(t):
    return builders.reasons(drafted(t), builders.builder("outline_regen", experimental=True))


@query(f"""WITH {_DRAFTED} SELECT unit_id, prompt_id, md5(rewrite) AS ai_text FROM dg WHERE why = 'ok' AND split = 'test'
QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY CASE prompt_id WHEN 'draft_style' THEN 0 WHEN 'draft_default' THEN 1 WHEN 'draft_formal' THEN 2 ELSE 99 END, line_no) = 1""")
def draft_evaluation(t):
    return builders.evaluation(drafted(t), builders.builder("outline_regen", experimental=True)).select("unit_id", "prompt_id", F.md5("ai_text").alias("ai_text"))


@query(f"""WITH {UNITS}, d AS (SELECT user_id % 50 AS user_id, event_type FROM events), m AS (SELECT unit_id, prompt_id, model FROM u CROSS JOIN (VALUES ('default', 'a'), ('formal', 'a'), ('style_mimic@b', 'b')) p(prompt_id, model) WHERE split = 'val')
SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.unit_id = m.unit_id AND r.prompt_id = m.prompt_id AND rewrite <> '')""")
def builder_jobs(t):
    return builders.jobs(builders.pilot(units(t), ["val"]), [("a", ["default", "formal"]), ("b", ["style_mimic"])], rewrites(t).where("rewrite <> ''"))


@query(f"WITH {UNITS} SELECT unit_id, split FROM u WHERE split IN ('val', 'test') ORDER BY md5('7|' || unit_id), unit_id LIMIT 12")
def pilot_sample(t):
    return builders.pilot(units(t), ["val", "test"], 12).select("unit_id", "split")


@query(f"""WITH {UNITS}, tm AS (SELECT u.text AS original, rewrite FROM r JOIN u USING (unit_id) WHERE split = 'train' AND rewrite <> ''), {_gate('tm', 'g')}
SELECT y, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM (SELECT text, 1 AS y FROM u WHERE split = 'train' UNION ALL SELECT rewrite, 0 FROM g WHERE why = 'ok') GROUP BY y""")
def train_material(t):
    return builders.train_material(units(t), rewrites(t)).groupBy("y").agg(F.count("*").alias("texts"), F.sum(F.length("text")).cast("long").alias("chars"))


_HITS = " + ".join(f"(length({{c}}) - length(replace({{c}}, '{m}', ''))) / {len(m)}" for m in MARKS)


def p_of(c: str):
    """A score that marks and length make: what a detector gives stands in for it where one is loaded."""
    found = sum((T.hits(F.col(c), F.lit(m)) for m in MARKS), F.lit(0.0))
    return F.round(1 / (1 + 10 * found / F.greatest(F.lit(1), F.length(c))), 6)


def _p(c: str) -> str:
    return f"round(1 / (1 + 10 * ({_HITS.format(c=c)}) / greatest(1, length({c}))), 6)"


@query(f"""WITH {UNITS}, h AS (SELECT unit_id, text AS original FROM u WHERE split IN ('val', 'test')), hr AS (SELECT h.original, r.* FROM r JOIN h USING (unit_id) WHERE rewrite <> ''), {_gate('hr', 'g')},
a AS (SELECT * FROM g WHERE why = 'ok' QUALIFY row_number() OVER (PARTITION BY unit_id, prompt_id ORDER BY line_no) = 1),
b AS (SELECT *, CASE WHEN contains(prompt_id, '@') THEN 'source=' || split_part(prompt_id, '@', 2) ELSE 'source=first' END AS source FROM a),
s AS (SELECT 'all' AS slice, 1 AS y, original AS t FROM h UNION ALL SELECT 'all', 0, rewrite FROM b UNION ALL SELECT source, 0, rewrite FROM b UNION ALL SELECT source, 1, original FROM h CROSS JOIN (SELECT DISTINCT source FROM b)
  UNION ALL SELECT CASE WHEN length(original) < 80 THEN 'len=0-80' WHEN length(original) < 200 THEN 'len=80-200' ELSE 'len=200-' END, y, t FROM (SELECT original, 1 AS y, original AS t FROM h UNION ALL SELECT original, 0, rewrite FROM b)),
q AS (SELECT slice, y, {_p('t')} AS p FROM s), {_auc('q', 'slice')}""")
def held_out_check(t):
    return metrics.separation(builders.held_out(units(t), rewrites(t)).select("slice", "y", p_of("text").alias("p")), "slice")


def outputs(t) -> DataFrame:
    """(system, unit_id, output, line_no) of three systems, one id written twice by one of them."""
    own = units(t).where("split = 'test'")
    copy = own.select(F.lit("copy").alias("system"), "unit_id", F.concat("text", F.lit("尾")).alias("output"), F.col("doc_id").alias("line_no"))
    cut = own.select(F.lit("cut.v1"), "unit_id", F.left("text", F.floor(F.length("text") / 2).cast("int")), "doc_id")
    odd = own.select(F.lit("numbers"), "unit_id", F.concat("text", F.when(F.col("doc_id") % 20 == 0, " 5,123").otherwise("")), "doc_id")
    return copy.union(cut).union(odd).union(own.where("doc_id % 20 = 0").select(F.lit("copy"), "unit_id", F.lit("较早的 another"), F.col("doc_id") - 1000000))


def inputs(t) -> DataFrame:
    return units(t).where("split = 'test'").select("unit_id", F.concat("text", F.lit("尾")).alias("input"), F.col("text").alias("original"))


_OUT = f"""{UNITS}, ts AS (SELECT doc_id, unit_id, text || '尾' AS input, text AS original FROM u WHERE split = 'test'),
o AS (SELECT 'copy' AS system, unit_id, input, original, original || '尾' AS output FROM ts UNION ALL SELECT 'cut.v1', unit_id, input, original, left(original, CAST(length(original) // 2 AS BIGINT)) FROM ts
  UNION ALL SELECT 'numbers', unit_id, input, original, original || CASE WHEN doc_id % 20 = 0 THEN ' 5,123' ELSE '' END FROM ts)"""


def _chrf(rows: str, result: str = "chrf") -> str:
    """SQL of chrF++ over rows (system, id, hyp, ref)."""
    side = f"SELECT system, id, 1 AS side, hyp AS t FROM {rows} UNION ALL SELECT system, id, 2, ref FROM {rows}"
    chars = " UNION ALL ".join(f"SELECT system, id, side, 'c{n}' AS n, substr(c, i, {n}) AS g FROM ci WHERE i <= length(c) - {n - 1}" for n in range(1, 7))
    return rf"""bt AS ({side}), ci AS (SELECT *, unnest(range(1, length(c) + 1)) AS i FROM (SELECT system, id, side, regexp_replace(t, '\s+', '', 'g') AS c FROM bt)),
wl AS (SELECT system, id, side, flatten(list_transform(list_filter(string_split_regex(t, '\s+'), lambda x: x <> ''), lambda x: CASE WHEN length(x) > 1 AND regexp_matches(x, '[[:punct:]]$') THEN [left(x, -1), right(x, 1)]
  WHEN length(x) > 1 AND regexp_matches(x, '^[[:punct:]]') THEN [left(x, 1), substr(x, 2)] ELSE [x] END)) AS w FROM bt),
wi AS (SELECT system, id, side, w, unnest(range(1, len(w) + 1)) AS i FROM wl),
gr AS ({chars} UNION ALL SELECT system, id, side, 'w1', w[i] FROM wi UNION ALL SELECT system, id, side, 'w2', w[i] || chr(0) || w[i + 1] FROM wi WHERE i < len(w)),
ge AS (SELECT system, id, n, g, count_if(side = 1) AS h, count_if(side = 2) AS r FROM gr GROUP BY ALL), gd AS (SELECT system, id, n, sum(h) AS h, sum(r) AS r, sum(least(h, r)) AS m FROM ge GROUP BY ALL),
go AS (SELECT system, n, sum(CASE WHEN r > 0 THEN h ELSE 0 END) AS h, sum(r) AS r, sum(m) AS m FROM gd GROUP BY ALL), ga AS (SELECT system, avg(m / h) AS p, avg(m / r) AS q FROM go WHERE h > 0 AND r > 0 GROUP BY system),
{result} AS (SELECT system, round(coalesce(100 * 5 * p * q / nullif(4 * p + q, 0), 0), 6) AS chrf FROM ga)"""


_DRIFT = rf"""dv AS (SELECT *, {_VAL.format('input')} AS va, {_VAL.format('output')} AS vb FROM o),
dd AS (SELECT *, len(list_filter(va, lambda x: NOT list_contains(vb, x))) + len(list_filter(vb, lambda x: NOT list_contains(va, x) AND NOT (x = '3.00000e+00' AND contains(input, '三')))) > 0 AS drift FROM dv)"""


@query(f"""WITH {_OUT}, {_DRIFT}, x AS (SELECT system, unit_id AS id, output AS hyp, original AS ref FROM o), {_chrf('x')},
m AS (SELECT system, round(avg(p), 6) AS p_human, round(avg((p > 0.5)::INT), 6) AS above_half, round(1000.0::DOUBLE * sum(h) / greatest(1, sum(n)), 6) AS marker_rate, round(avg(drift::INT), 6) AS number_err, round(median(CAST(n / greatest(1, length(original)) AS DOUBLE)), 6) AS len_ratio
  FROM (SELECT *, {_p('output')} AS p, {_HITS.format(c='output')} AS h, length(output) AS n FROM dd) GROUP BY system)
SELECT m.system, chrf, p_human, above_half, marker_rate, number_err, len_ratio FROM m JOIN chrf USING (system)""")
def system_scorecard(t):
    spark, folder = t("documents").sparkSession, files.scratch(t("documents").sparkSession)
    rows = outputs(t)
    # as many systems as the rows above name
    for name in ("copy", "cut.v1", "numbers"):
        files.write_jsonl(rows.where(F.col("system") == name).drop("system"), f"{folder}/{name}.jsonl")
    read = files.system_outputs(spark, f"{folder}/*.jsonl", "unit_id string, output string, line_no long")
    return metrics.system_scores(metrics.aligned_outputs(inputs(t), read).withColumn("p", p_of("output")), MARKS)


@query(f"""WITH {_OUT}, l AS (SELECT system, input, output, {_p('input')} AS p_in, {_p('output')} AS p_out, {_HITS.format(c='input')} AS h_in, {_HITS.format(c='output')} AS h_out FROM o),
s AS (SELECT system, p_out AS p, h_out AS h, length(output) AS n FROM l UNION ALL SELECT 'ai_input', p_in, h_in, length(input) FROM l WHERE system = 'copy')
SELECT system, round(avg(p), 6) AS p_human, round(1000.0::DOUBLE * sum(h) / sum(n), 6) AS marker_rate, count(*) AS paragraphs FROM s GROUP BY system""")
def block_log_scores(t):
    spark, folder = t("documents").sparkSession, files.scratch(t("documents").sparkSession)
    rows = metrics.aligned_outputs(inputs(t), outputs(t)).select("system", "input", "output", F.array(F.lit(0)).alias("blocks"))
    for name in ("copy", "cut.v1", "numbers"):
        files.write_jsonl(rows.where(F.col("system") == name).drop("system"), f"{folder}/post.{name}.blocks.jsonl")
    logs = files.block_logs(spark, f"{folder}/*.blocks.jsonl")
    return metrics.article_means(logs.withColumns({"p_in": p_of("input"), "p_out": p_of("output")}), MARKS)


@query(f"""WITH {_OUT}, l AS (SELECT system, {_p('input')} AS p_in, {_p('output')} AS p_out, {_HITS.format(c='input')} AS h_in, {_HITS.format(c='output')} AS h_out, length(input) AS n_in, length(output) AS n_out FROM o)
SELECT system, round(avg(p_in), 6) AS p_in, round(1000.0::DOUBLE * sum(h_in) / sum(n_in), 6) AS m_in, round(avg(p_out), 6) AS p_out, round(1000.0::DOUBLE * sum(h_out) / sum(n_out), 6) AS m_out FROM l GROUP BY system""")
def compare_means(t):
    rows = metrics.aligned_outputs(inputs(t), outputs(t))
    return metrics.compare_stats(rows.withColumns({"p_in": p_of("input"), "p_out": p_of("output")}), MARKS)


_CURVE = "c AS (SELECT label AS step, label / 10.0::DOUBLE AS epoch, round(avg(embedding[1]) + 1, 6) AS loss FROM embeddings WHERE label <> 3 GROUP BY label)"


def curve(t) -> DataFrame:
    """A training log written and read again: rows without a loss and blank lines among them."""
    spark, folder = t("embeddings").sparkSession, files.scratch(t("embeddings").sparkSession)
    rows = t("embeddings").where("label <> 3").groupBy(F.col("label").alias("step")).agg(F.round(F.avg(F.col("embedding")[0].cast("double")) + 1, 6).alias("eval_loss"))
    rows = rows.select("step", (F.col("step") / 10).alias("epoch"), F.lit(1.5).alias("elapsed_s"), "eval_loss")
    files.write_jsonl(rows.unionByName(rows.withColumn("eval_loss", F.lit(None).cast("double"))), f"{folder}/log.jsonl")
    return files.loss_curve(spark, f"{folder}/log.jsonl")


@query(f"WITH {_CURVE} SELECT step, epoch, loss AS eval_loss FROM c ORDER BY loss, step LIMIT 3")
def lowest_losses(t):
    return metrics.lowest(curve(t))


_CHECKPOINTS = f"""{_CURVE}, {UNITS}, cp AS (SELECT s AS step, unit_id, text AS original, CASE WHEN s = 1 THEN text ELSE left(text, CAST(length(text) // s AS BIGINT)) || CASE WHEN s = 2 THEN ' 77' ELSE '' END END AS output FROM u CROSS JOIN (VALUES (1), (2), (3), (4)) v(s) WHERE split = 'val'),
sc AS (SELECT step, round(avg({_p('output')}), 6) AS p, round(1000.0::DOUBLE * sum({_HITS.format(c='output')}) / sum(length(output)), 6) AS rate, round(avg(length(output)), 6) AS chrf, round(avg(contains(output, '77')::INT), 6) AS err FROM cp GROUP BY step),
og AS (SELECT p AS p0, rate AS rate0 FROM sc WHERE step = 1),
fl AS (SELECT sc.step, chrf, loss AS val_loss, list_filter([CASE WHEN p > p0 + 0.03 OR rate < 0.6 * rate0 THEN 'overshoot' END, CASE WHEN err > 0.05 THEN 'number_drift' END], lambda x: x IS NOT NULL) AS flags FROM sc CROSS JOIN og LEFT JOIN c USING (step))"""


def checkpoints(t) -> DataFrame:
    """Outputs of one run's checkpoints, and of another's, written and read again, then scored and flagged."""
    spark, folder = t("documents").sparkSession, files.scratch(t("documents").sparkSession)
    own = units(t).where("split = 'val'")
    for s in (1, 2, 3, 4):
        cut = F.col("text") if s == 1 else F.concat(F.left("text", F.floor(F.length("text") / s).cast("int")), F.lit(" 77" if s == 2 else ""))
        files.write_jsonl(own.select("unit_id", cut.alias("output")), f"{folder}/run_{s}.jsonl")
    files.write_jsonl(own.select("unit_id", F.col("text").alias("output")), f"{folder}/runner_9.jsonl")
    rows = files.checkpoint_outputs(spark, f"{folder}/*.jsonl", "run", "unit_id string, output string")
    rows = rows.join(own.select("unit_id", F.col("text").alias("original")), "unit_id").withColumn("p", p_of("output"))
    rate = features.marker_rate(rows.select("step", F.col("output").alias("text")), MARKS, "step").select("step", "rate")
    sums = rows.groupBy("step").agg(F.round(F.avg("p"), 6).alias("p"), F.round(F.avg(F.length("output")), 6).alias("chrf"), F.round(F.avg(F.contains("output", F.lit("77")).cast("int")), 6).alias("err"))
    scored = sums.join(rate, "step")
    base = scored.where("step = 1").head()
    return metrics.with_losses(scored.withColumn("flags", metrics.flags(p0=base.p, rate0=base.rate)), curve(t))


@query(f"WITH {_CHECKPOINTS} SELECT CAST(step AS BIGINT) AS step, chrf, val_loss, array_to_string(flags, ' ') AS flags FROM fl ORDER BY len(flags) > 0, val_loss NULLS LAST, chrf DESC, step LIMIT 1")
def checkpoint_selection(t):
    return metrics.recommend(checkpoints(t)).select("step", "chrf", "val_loss", F.array_join("flags", " ").alias("flags"))


@query(f"""WITH {_CHECKPOINTS}, b AS (SELECT arg_min(step, (loss, step)) AS best, arg_min(epoch, (loss, step)) AS ep, min(loss) AS low, min(step) AS first, arg_max(loss, step) AS last, count(*) AS n FROM c)
SELECT note FROM (SELECT CASE WHEN best = first AND n > 1 THEN 'validation loss is lowest at the first evaluation (epoch ' || printf('%.2f', ep) || '): train shorter or evaluate earlier' END AS note FROM b
UNION ALL SELECT CASE WHEN last > low * 1.05 THEN 'validation loss rose ' || printf('%.0f', 100 * (last / low - 1)) || '% after its minimum at epoch ' || printf('%.2f', ep) || ': memorisation' END FROM b
UNION ALL SELECT CASE WHEN count(*) > 0 AND count_if(len(flags) = 0) = 0 THEN 'every scored checkpoint is flagged: train shorter or slower' END FROM fl) WHERE note IS NOT NULL
UNION ALL SELECT 'checkpoints ' || count(*) FROM fl""")
def selection_notes(t):
    scored = checkpoints(t)
    seen = scored.agg(F.concat(F.lit("checkpoints "), F.count("*").cast("string")).alias("note"))
    return metrics.selection_notes(curve(t), scored).unionByName(seen)


_BLIND = f"""{UNITS}, bp AS (SELECT doc_id, text AS original, left(text || '尾', 420) AS rewrite FROM u WHERE length(text) BETWEEN 60 AND 420 AND split <> 'train'),
bi AS (SELECT *, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) - 1 AS k FROM bp),
it AS (SELECT doc_id, k, CASE WHEN k < 8 THEN 'own' WHEN k < 16 THEN 'rewritten' ELSE 'pair' END AS kind, CASE WHEN ascii(md5('7|' || doc_id)) % 2 = 0 THEN 'left' ELSE 'right' END AS own_side FROM bi WHERE k < 24)"""


def blind_pairs(t) -> DataFrame:
    """Originals beside a model's and a baseline's outputs, which both are to be there."""
    own = units(t).where("split <> 'train'").select("doc_id", F.col("text").alias("original"))
    model = own.select("doc_id", F.left(F.concat("original", F.lit("尾")), F.lit(420)).alias("rewrite"))
    return own.join(model, "doc_id").join(own.select("doc_id", F.col("original").alias("baseline")).where("baseline <> ''"), "doc_id")


@query(f"WITH {_BLIND} SELECT CASE WHEN k < 16 THEN printf('s1-%02d', k) ELSE printf('s2-%02d', k - 16) END AS id, kind, doc_id, CASE WHEN kind = 'pair' THEN own_side END AS own_side FROM it")
def blind_items(t):
    return articles.blind_items(blind_pairs(t), "doc_id", 8, 8).select("id", "kind", "doc_id", "own_side")


@query(f"""WITH {_BLIND}, an AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN kind = 'pair' THEN CASE doc_id % 3 WHEN 0 THEN 'left' WHEN 1 THEN 'right' ELSE 'tie' END ELSE CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END END AS a FROM it),
n AS (SELECT count_if(kind <> 'pair' AND a IS NOT NULL)::BIGINT AS s1_answered, count_if(kind = 'rewritten' AND a = 'true')::BIGINT AS s1_rewrites_taken, count_if(kind = 'rewritten')::BIGINT AS s1_rewrites, count_if(kind = 'own' AND a = 'true')::BIGINT AS s1_originals_taken,
 count_if(kind = 'own')::BIGINT AS s1_originals, count_if(kind = 'pair' AND a IS NOT NULL)::BIGINT AS s2_answered, count_if(kind = 'pair' AND a IN ('left', 'right') AND a <> own_side)::BIGINT AS s2_wins, count_if(kind = 'pair' AND a IN ('left', 'right'))::BIGINT AS s2_decided FROM an)
SELECT *, CASE WHEN s2_decided > 0 THEN round((SELECT sum(exp(lgamma(s2_decided + 1) - lgamma(i + 1) - lgamma(s2_decided - i + 1) - s2_decided * ln(2))) FROM (SELECT unnest(range(s2_wins, s2_decided + 1)) AS i)) + 1e-9, 4) END AS s2_p_value FROM n""")
def blind_result(t):
    items = articles.blind_items(blind_pairs(t), "doc_id", 8, 8)
    side = F.when(F.col("doc_id") % 3 == 0, "left").when(F.col("doc_id") % 3 == 1, "right").otherwise("tie")
    said = F.when(F.col("kind") == "pair", side).otherwise(F.when(F.col("doc_id") % 2 == 0, "true").otherwise("false"))
    given = items.where("doc_id % 5 <> 0").select("id", said.alias("answer"))
    # one JSON file of answers, of as many rows as a person gives
    spark, folder = items.sparkSession, files.scratch(items.sparkSession)
    held = {r.id: {"true": True, "false": False}.get(r.answer, r.answer) for r in given.collect()}
    files.report(spark, f"{folder}/answers.json", {s: {"answers": {k: v for k, v in held.items() if k.startswith(s)}} for s in ("s1", "s2")} | {"other": {}})
    read = files.answers(spark, f"{folder}/answers.json").select(F.explode("answers").alias("id", "answer"))
    return metrics.blind_score(items, read)


@query("""SELECT event_type, count(*) AS calls, count_if(value < 10)::BIGINT AS failed, CAST(coalesce(sum(event_id % 100), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(CASE WHEN value >= 10 THEN event_id % 7 END), 0) AS BIGINT) AS completion_tokens FROM events GROUP BY event_type""")
def usage_totals(t):
    used = F.create_map(F.lit("prompt_tokens"), F.col("event_id") % 100, F.lit("completion_tokens"), F.when(F.col("value") >= 10, F.col("event_id") % 7))
    rows = t("events").select("event_type", F.when(F.col("value") < 10, "timeout").alias("error"), used.alias("usage"))
    return metrics.usage_totals(rows, "event_type")


@query("SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def jsonl_round_trip(t):
    spark, folder = t("conversations").sparkSession, files.scratch(t("conversations").sparkSession)
    rows = t("conversations")
    files.write_jsonl(rows.where("turn % 2 = 0"), f"{folder}/rows.jsonl")
    files.append_jsonl(rows.where("turn % 2 <> 0"), f"{folder}/rows.jsonl")
    return files.jsonl(spark, f"{folder}/rows.jsonl", "conv_id long, turn long, role string, text string").select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("SELECT user_id, event_type, count(*) AS runs FROM events WHERE value >= 20 GROUP BY ALL")
def done_log(t):
    spark, folder = t("events").sparkSession, files.scratch(t("events").sparkSession)
    rows = t("events").select("event_id", "user_id", "event_type", F.when(F.col("value") < 20, "HTTP 500").otherwise(F.when(F.col("event_id") % 2 == 0, "")).alias("error"))
    files.append_jsonl(rows, f"{folder}/log.jsonl")
    read = files.jsonl(spark, f"{folder}/log.jsonl", "event_id long, user_id long, event_type string, error string")
    return files.done_keys(read, "user_id", "event_type", "event_id").groupBy("user_id", "event_type").agg(F.count("*").alias("runs"))


@query("SELECT item_id || '.part' AS slug, md5(text) AS digest FROM benchmark")
def post_files(t):
    spark, folder = t("benchmark").sparkSession, files.scratch(t("benchmark").sparkSession)
    # a file a post, in a folder of its own name, as a text file holds nothing but its text
    t("benchmark").select(F.concat(F.col("item_id").cast("string"), F.lit(".part.md")).alias("name"), "text").write.option("lineSep", "\u0001").partitionBy("name").text(f"{folder}/posts")
    rows = files.posts(spark, [f"{folder}/posts/*"])
    return rows.select(F.regexp_extract("path", r"name=([^/]+)\.md", 1).alias("slug"), F.md5(F.regexp_replace("raw", "\u0001$", "")).alias("digest"))


@query("""WITH p AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS was FROM documents WHERE doc_id % 3 = 0),
l AS (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[A-Za-zÀ-ÿ]'))) AS units FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS slug, coalesce(was, 'train') AS split, CAST(units AS VARCHAR) AS units FROM l LEFT JOIN p USING (doc_id)""")
def split_override(t):
    spark, folder = t("documents").sparkSession, files.scratch(t("documents").sparkSession)
    was = F.when(F.col("doc_id") % 4 == 0, "train").when(F.col("doc_id") % 4 == 1, "val").otherwise("test")
    files.write_csv(t("documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("slug"), was.alias("split")), f"{folder}/split.csv")
    count = F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike("[A-Za-zÀ-ÿ]")))
    posts = corpus.with_split(t("documents").select(F.col("doc_id").cast("string").alias("slug"), count.alias("units")), files.split_overrides(spark, f"{folder}/split.csv"))
    files.write_csv(posts, f"{folder}/posts.csv")
    return spark.read.option("header", True).csv(f"{folder}/posts.csv").select("slug", "split", "units")


@query(f"WITH {UNITS} SELECT split, count(DISTINCT doc_id // 5) AS posts, count(*) AS units, CAST(sum(length(text)) AS BIGINT) AS chars FROM u GROUP BY split")
def corpus_report(t):
    return corpus.corpus_report(units(t).withColumn("slug", F.floor(F.col("doc_id") / 5)))


_RAW = """raw AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) ELSE '' END || 'Title: ' || source || chr(10) || 'Date: ' || CASE WHEN doc_id % 7 = 0 THEN '2020-2-30' ELSE '20' || (10 + doc_id % 15) || '-' || (1 + doc_id % 12) || '-' || (1 + doc_id % 28) || ' 23:00' END || chr(10) || 'Tags: ' || lang || ', AI' || chr(10)
 || 'Title: again ' || source || chr(10) || CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) WHEN 1 THEN chr(10) ELSE 'not a key' || chr(10) END || b AS raw, b FROM (SELECT *, translate(lower(left(text, 300)), '{l}', '{h}') || chr(10) || '- - -' || chr(10) || '| a' || chr(10) || '| b |' || chr(10) || 'x[](u)[甲]()y' || chr(10) || '> q' AS b FROM documents)),
h AS (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN chr(10) || b WHEN doc_id % 3 = 2 THEN 'not a key' || chr(10) || b ELSE b END AS body, 'again ' || (SELECT source FROM documents d WHERE d.doc_id = raw.doc_id) AS title,
 CASE WHEN doc_id % 7 <> 0 THEN make_date(2010 + doc_id % 15, 1 + doc_id % 12, 1 + doc_id % 28) END AS date FROM raw)""".replace("{l}", LETTERS).replace("{h}", HANS)
_CLEAN = r"""array_to_string(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(body, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', '', 'g'), chr(10)),
 lambda x: CASE WHEN regexp_matches(x, '^\s*(#{1,6}\s|\|.*\|\s*$|>|([-*_]\s*){3,}$)') THEN '' ELSE rtrim(x, ' ' || chr(9)) END), chr(10))"""


def raw_posts(t) -> DataFrame:
    """Posts with heads of three kinds: fenced, bare, and bare with a line that ends it."""
    d, s = F.col("doc_id"), F.lit("\n")
    text = lambda c: c.cast("string")
    body = F.concat(F.translate(F.lower(F.left("text", F.lit(300))), LETTERS, HANS), F.lit("\n- - -\n| a\n| b |\nx[](u)[甲]()y\n> q"))
    date = F.when(d % 7 == 0, "2020-2-30").otherwise(F.concat(F.lit("20"), text(10 + d % 15), F.lit("-"), text(1 + d % 12), F.lit("-"), text(1 + d % 28), F.lit(" 23:00")))
    end = F.when(d % 3 == 0, "---\n").when(d % 3 == 1, "\n").otherwise("not a key\n")
    raw = F.concat(F.when(d % 3 == 0, "---\n").otherwise(""), F.lit("Title: "), F.col("source"), s, F.lit("Date: "), date, s, F.lit("Tags: "), F.col("lang"), F.lit(", AI\nTitle: again "), F.col("source"), s, end, body)
    head = t("documents").select("doc_id", "source", "lang", T.header(raw).alias("h"))
    return head.select("doc_id", F.col("h.meta")["Title"].alias("title"), T.date_of(F.col("h.meta")["Date"]).alias("date"), F.split(F.col("h.meta")["Tags"], ",").alias("tags"), F.col("h.body").alias("body"))


@query(f"WITH {_RAW} SELECT doc_id, title, strftime(date, '%Y-%m-%d') AS date, md5(body) AS body, md5({_CLEAN}) AS clean FROM h")
def post_heads(t):
    return raw_posts(t).select("doc_id", "title", F.date_format("date", "yyyy-MM-dd").alias("date"), F.md5("body").alias("body"), F.md5(T.clean_markdown(F.col("body"))).alias("clean"))


@query(f"""WITH {_RAW}, f AS (SELECT h.*, lang, {_CLEAN} AS c FROM h JOIN documents USING (doc_id)),
x AS (SELECT *, len(regexp_extract_all(c, '[\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}]')) AS hn, len(regexp_extract_all(c, '[A-Za-z]')) AS ln FROM f)
SELECT coalesce(CASE WHEN doc_id IN (3, 5) THEN 'slug' WHEN doc_id % 11 = 4 THEN 'filename_suffix' WHEN lang = 'de' THEN 'tag' WHEN doc_id % 13 = 6 THEN 'status' WHEN date IS NULL THEN 'no_date'
 WHEN date NOT BETWEEN DATE '2011-01-01' AND DATE '2020-12-31' THEN 'date_range' WHEN hn / greatest(1, hn + ln) < 0.15 THEN 'not_chinese' END, 'kept') AS reason, count(*) AS posts FROM x GROUP BY 1""")
def post_exclusions(t):
    d = F.col("doc_id")
    posts = raw_posts(t).withColumns({"slug": d.cast("string"), "name": F.concat(d.cast("string"), F.when(d % 11 == 4, "-EN.md").otherwise(".md")), "status": F.when(d % 13 == 6, "Draft").otherwise("published")})
    rules = corpus.post_rules(["3", "5"], ["-EN.md"], ["DE"], ["draft"], "2011-01-01", "2020-12-31")
    return corpus.exclusion_counts(posts.withColumn("reason", F.coalesce(corpus.exclusion_reason(rules), F.lit("kept")))).withColumnRenamed("n", "posts")


@query(f"""WITH {UNITS}, g AS (SELECT unnest(regexp_extract_all(regexp_replace(text, '\\s', '', 'g'), '[\\x{{4E00}}-\\x{{9FFF}}]+')) AS w, doc_id % 2 AS y FROM u), i AS (SELECT w, y, unnest(range(1, length(w) + 1)) AS i FROM g),
n AS (SELECT substr(w, i, 2) AS gram, y FROM i WHERE i < length(w) UNION ALL SELECT substr(w, i, 3), y FROM i WHERE i < length(w) - 1 UNION ALL SELECT substr(w, i, 4), y FROM i WHERE i < length(w) - 2),
c AS (SELECT gram, count_if(y = 1)::BIGINT AS own, count_if(y = 0)::BIGINT AS other FROM n GROUP BY gram)
SELECT gram, own, other, round(ln((other + 1) / (SELECT sum(other) FROM c)) - ln((own + 1) / (SELECT sum(own) FROM c)), 6) AS score FROM c WHERE other >= 20""")
def script_lexicon(t):
    rows = units(t).select("text", (F.col("doc_id") % 2).cast("int").alias("y"))
    return features.log_odds(features.script_grams(rows), "gram", "y").withColumn("score", F.round("score", 6))


@query(f"""WITH {UNITS} SELECT unit_id, md5(translate(text || '“甲”；乙：丙，（丁）！戊？', '“”„＂‘’＇；：，（）！？', '\"\"\"\"''''''' || ';:,()!?')) AS plain, coalesce(nullif(trim(regexp_replace(left(text, 20) || ' A b_C', '[^A-Za-z0-9_-]+', '-', 'g'), '-'), ''), 'eval') AS slug,
 md5(trim(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^["“”]+|["“”]+$', '', 'g'))) AS answer, least(2048, CAST(floor(length(text) * 1.6) AS BIGINT) + 64) AS budget, least(2048, 3 * length(text) + 200) AS generation,
 CASE WHEN contains(prev, '1') THEN 'first' ELSE 'b' END AS family FROM u""")
def small_rules(t):
    c, p = F.col("text"), F.col("prev")
    family = T.source_family(F.when(F.contains(p, F.lit("1")), "formal").otherwise("formal@b"))
    said = F.concat(F.lit("<think>x\ny</think>\n【改写后的段落】\n“"), T.strip(c), F.lit("”"))
    return units(t).select(
        "unit_id", F.md5(T.normalize_marks(F.concat(c, F.lit("“甲”；乙：丙，（丁）！戊？")))).alias("plain"), T.slugify(F.concat(F.left(c, F.lit(20)), F.lit(" A b_C"))).alias("slug"),
        F.md5(T.clean_output(said)).alias("answer"), T.token_budget(c).cast("long").alias("budget"), P.generation_budget(c).cast("long").alias("generation"), family.alias("family"),
    )


_PARA = f"CASE prompt_id WHEN 'formal' THEN '{P.PARAPHRASE['formal']}' WHEN 'default' THEN '{P.PARAPHRASE['default']}' WHEN 'condense' THEN '{P.PARAPHRASE['condense']}' END"


@query(f"""WITH {UNITS}, n AS (SELECT *, chr(10) || chr(10) AS z FROM u CROSS JOIN (VALUES ('formal'), ('default'), ('condense')) p(prompt_id))
SELECT unit_id, prompt_id, md5({_PARA} || z || '{P.PARAPHRASE_RULES}' || z || CASE WHEN prev <> '' THEN '【上文，仅帮助理解语境，不要改写、不要输出】' || chr(10) || prev || z ELSE '' END || '【需要改写的段落】' || chr(10) || text) AS asked,
 md5('{P.EXTRACT}' || z || '【文章】' || chr(10) || text) AS extract,
 md5(replace('{P.DRAFT['draft_default']}', '{{n}}', CAST(length(text) AS VARCHAR)) || z || '{P.DRAFT_RULES}' || z || '【要点与事实】' || chr(10) || 'a') AS draft,
 md5('{P.FEW_SHOT[0].format(name='乙')}' || z || '【例1】' || chr(10) || 'e1' || z || '【例2】' || chr(10) || 'e2' || z || '{P.FEW_SHOT[1].format(name='乙')}' || z || CASE WHEN prev <> '' THEN '【上文，仅供参考，不要改写】' || chr(10) || prev || z ELSE '' END || '【目标段落】' || chr(10) || text) AS shots FROM n""")
def model_requests(t):
    rows = units(t).select("*", F.explode(F.array(*map(F.lit, ("formal", "default", "condense")))).alias("prompt_id"))
    rows = P.exemplified(rows, t("benchmark").where("item_id < 0").select("text"), "prompt_id", "style_mimic")
    c, prev, none = F.col("text"), F.col("prev"), F.col("exemplars")
    return rows.select(
        "unit_id", "prompt_id", F.md5(P.paraphrase(F.col("prompt_id"), c, prev, none)).alias("asked"), F.md5(P.extract(c)).alias("extract"),
        F.md5(P.draft(F.lit("draft_default"), c, F.lit("a"), none)).alias("draft"), F.md5(P.few_shot("乙", c, prev, F.array(F.lit("e1"), F.lit("e2")))).alias("shots"),
    )


@query(f"""WITH {UNITS}, w AS (SELECT list(text ORDER BY text) AS x, count(*) AS n FROM (SELECT DISTINCT text FROM benchmark)),
h AS (SELECT unit_id, CAST('0x' || left(md5(unit_id || '|style_mimic'), 12) AS BIGINT) AS h FROM u), f AS (SELECT unit_id, h % n AS a, (h % n + 1 + (h // n) % (n - 1)) % n AS b, x FROM h CROSS JOIN w)
SELECT unit_id, md5('【示例一】' || chr(10) || x[a + 1] || chr(10) || chr(10) || '【示例二】' || chr(10) || x[b + 1]) AS shown FROM f""")
def style_exemplars(t):
    rows = P.exemplified(units(t).select("unit_id", F.lit("style_mimic").alias("prompt_id")), t("benchmark").select("text"), "prompt_id", "style_mimic")
    return rows.select("unit_id", F.md5(P.examples_block(F.col("exemplars"))).alias("shown"))


@query(f"""WITH {UNITS}, p AS (SELECT doc_id, '段落' || text || text AS a, '# ' || text AS b FROM u), q AS (SELECT doc_id, unnest([a, b, regexp_replace(a, '的', '[的](u)', 'g')]) AS x FROM p),
t AS (SELECT doc_id, regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g') AS text, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS s FROM q WHERE doc_id % 10 <> 3)
SELECT md5(text) AS digest, count(*) AS n FROM t WHERE NOT regexp_matches(s, '^(#|!|\\||>|```|<|-|\\*)') AND length(s) BETWEEN 150 AND 400 AND len(regexp_extract_all(s, '[\\x{{4E00}}-\\x{{9FFF}}]')) > 0.6 * length(s) GROUP BY 1""")
def exemplar_pool(t):
    a = F.concat(F.lit("段落"), "text", "text")
    raw = F.concat_ws("\n \n", a, F.concat(F.lit("# "), F.col("text")), F.regexp_replace(a, "的", "[的](u)"))
    posts = units(t).select(F.when(F.col("doc_id") % 10 == 3, "left.md").otherwise("a.md").alias("name"), raw.alias("raw"))
    return files.exemplars(posts, ["left.md"]).groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query(f"""WITH {UNITS}, x AS (SELECT 'han' AS system, unit_id AS id, left(text, 100) AS hyp, left(text, 120) || ' end.' AS ref FROM u), {_chrf('x')} SELECT system, chrf FROM chrf""")
def chrf_words(t):
    return metrics.chrf(units(t).select(F.lit("han").alias("system"), F.left("text", F.lit(100)).alias("hyp"), F.concat(F.left("text", F.lit(120)), F.lit(" end.")).alias("ref")))


@query(f"""WITH {UNITS}, gp AS (SELECT u.unit_id, prompt_id, u.text AS original, rewrite, line_no FROM r JOIN u USING (unit_id)), {_gate('gp', 'g')} SELECT unit_id, prompt_id, line_no, why FROM g""")
def han_gate(t):
    rows = rewrites(t).join(units(t).select("unit_id", F.col("text").alias("original")), "unit_id")
    return pairs.gate(rows, profile=HAN).select("unit_id", "prompt_id", "line_no", "why")
