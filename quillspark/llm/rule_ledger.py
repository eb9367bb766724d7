"""Quality rules: each rule is evaluated once into a bit of a ledger, beside its measurements; policies are bit masks.

Policies are versioned and cost one AND a row, so that a new one needs no new pass over the texts. Ablations come from
the counts of each distinct mask. Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: rule -> when it fails, by the measurements; the place of a rule is its bit.
RULES = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "shouting": "2 * n_upper > word_chars",
    "exclamations": "2 * n_exclamations > n_words",
}
BITS = {name: 1 << i for i, name in enumerate(RULES)}
#: version -> the rules that reject
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "v1": ("few_words", "repeated_words", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def mask(policy: str) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def count_of(text: Column, character: str) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(character), F.lit("")))


def repeated(words: str) -> str:
    """SQL: the words of an array that lie in a window met twice or more."""
    window = ", ".join(f"get({words}, i + {k})" for k in range(WINDOW))
    hashed = f"CASE WHEN size({words}) >= {WINDOW} THEN transform(sequence(0, size({words}) - {WINDOW}), i -> xxhash64({window})) END"
    return hashed


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements) of each row; null texts have no words, no lines and no characters."""
    text = F.coalesce("text", F.lit(""))
    plain = text
    for space in "\t\n\x0b\f\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t"), plain.alias("b"))
    lines = F.expr("filter(split(t, '\\n'), x -> length(trim(BOTH ' \t\x0b\f\r' FROM x)) > 0)")
    rows = rows.select("doc_id", "t", "b", F.array_remove(F.split("b", " "), "").alias("w"), lines.alias("l"))
    rows = rows.withColumn("g", F.transform("w", lambda x: F.xxhash64(x)))
    rows = rows.withColumn("h", F.expr(repeated("g")))
    rows = rows.withColumn("s", F.expr("CASE WHEN size(array_distinct(h)) < size(h) THEN sort_array(transform(h, (x, i) -> struct(x AS x, i AS i))) END"))
    # first places of windows that have an equal one, in order
    rows = rows.withColumn("p", F.expr("sort_array(transform(filter(transform(s, (e, j) -> struct(e.i AS i, (j > 0 AND e.x = get(s, j - 1).x) OR coalesce(e.x = get(s, j + 1).x, false) AS r)), e -> e.r), e -> e.i))"))
    count = lambda c: c.cast("long")
    return rows.select(
        "doc_id",
        count(F.size("w")).alias("n_words"),
        count(F.length("b") - count_of(F.col("b"), " ")).alias("word_chars"),
        count(F.regexp_count("t", F.lit(f"[{SYMBOLS}]"))).alias("n_symbols"),
        count(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        F.expr(f"CASE WHEN p IS NULL THEN 0L ELSE aggregate(p, struct(0L AS n, 0L AS end), (a, x) -> struct(a.n + x + {WINDOW} - greatest(a.end, x) AS n, CAST(x + {WINDOW} AS LONG) AS end), a -> a.n) END").alias("n_repeat_words"),
        count(F.size("l")).alias("n_lines"),
        count(F.regexp_count("t", F.lit(r"\p{Lu}"))).alias("n_upper"),
        count(count_of(F.col("t"), "!")).alias("n_exclamations"),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """measured() with `failed`, the bits of the rules that fail (a long)."""
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(0) for name, rule in RULES.items()]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured(docs).withColumn("failed", total.cast("long"))


def kept(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(entries: DataFrame) -> DataFrame:
    """(policy, rule, fails, alone): rows that fail a rule, and rows that only this rule of the policy rejects.

    entries: a ledger. At most 2 ** rules masks are left after the first aggregation.
    """
    masks = entries.groupBy("failed").agg(F.count("*").alias("n"))
    parts = [F.struct(F.lit(p).alias("policy"), F.lit(r).alias("rule"), F.lit(mask(p)).alias("mask"), F.lit(BITS[r]).alias("bit")) for p, rules in POLICIES.items() for r in rules]
    each = masks.select("failed", "n", F.explode(F.array(*parts)).alias("e")).select("failed", "n", "e.*")
    hit = F.col("failed").bitwiseAND(F.col("mask"))
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return each.groupBy("policy", "rule").agg(total(hit.bitwiseAND(F.col("bit")) != 0).alias("fails"), total(hit == F.col("bit")).alias("alone"))


def profile(entries: DataFrame, *by: str) -> DataFrame:
    """Bitwise aggregates of a ledger: rules that some row fails, and rules that every row fails."""
    return entries.groupBy(*by).agg(F.bit_or("failed").alias("some_fail"), F.bit_and("failed").alias("all_fail"), F.count("*").alias("n"))


def rules_report(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """Contract form, with the ledger's bits."""
    base = F.col("failed").bitwiseAND(F.lit(mask("base"))) != 0
    return ledger(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & kept(policy)).alias("kept"), "failed")
