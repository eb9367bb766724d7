"""Text functions as columns. All are built-in expressions; `split_long` alone is sequential and lives in udx.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.profiles import HAN, Profile

#: Quotes and full-width marks, and what they become.
MARKS = "“”„＂‘’＇；：，（）！？", "\"\"\"\"''';:,()!?"
NUMBER = r"\d+(?:\.\d+)?"
GROUPED = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?"
LIST_MARKER = r"(?m)(?:^|(?<=[\s:：；;。，,]))\d{1,2}\s*[.)）、](?!\d)"
TOKEN = r"[A-Za-z][A-Za-z0-9+\-.]*"
FULL_DIGITS = "０１２３４５６７８９"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def paragraphs(text: Column, profile: Profile = HAN) -> Column:
    """Stripped paragraphs that hold a letter of the profile, in order."""
    parts = F.split(F.coalesce(text, F.lit("")), profile.paragraph_break)
    return F.filter(F.transform(parts, strip), lambda x: x.rlike(profile.letter))


def header_end(lines: Column) -> Column:
    """Number of header lines: with a fence, up to the closing one or a blank line, and that line too; else the leading keys."""
    key, n = r"^[A-Za-z]+:\s*.*$", F.size(lines)
    places = F.sequence(F.lit(0), n)
    fenced = F.trim(lines[0]) == "---"
    stop = F.filter(places, lambda i: (i > 0) & ((i >= n) | F.trim(F.get(lines, i)).isin("---", "")))[0]
    bare = F.filter(places, lambda i: (i >= n) | ~F.coalesce(F.get(lines, i), F.lit("")).rlike(key))[0]
    return F.when(fenced, F.least(stop + 1, n)).otherwise(bare)


def header(raw: Column) -> Column:
    """struct<meta map, body>: `Key: value` lines of a post's head; a later key of one name wins."""

    def parted(lines: Column, end: Column) -> Column:
        head = F.filter(F.slice(lines, 1, end), lambda x: x.rlike(r"^[A-Za-z]+:"))
        pairs = F.transform(head, lambda x: F.struct(F.regexp_extract(x, "^([A-Za-z]+):", 1).alias("key"), strip(F.regexp_extract(x, "^[A-Za-z]+:(.*)$", 1)).alias("value")))
        last = let(pairs, lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p) + 1), lambda y: y["key"] == x["key"])))
        return F.struct(F.map_from_entries(last).alias("meta"), F.array_join(F.slice(lines, end + 1, F.size(lines) + 1), "\n").alias("body"))

    # a lambda works out what it names anew for each item, so the lines are bound first
    return let(F.split(raw, "\n"), lambda lines: let(header_end(lines), lambda end: parted(lines, end)))


def date_of(c: Column) -> Column:
    """The date a text begins with; null if there is none or it isn't in the calendar."""
    return F.try_to_date(F.nullif(F.regexp_extract(c, r"(?U)^\s*(\d{4}-\d{1,2}-\d{1,2})", 1), F.lit("")), "yyyy-M-d")


def script_ratio(c: Column, letter: str = "[一-鿿㐀-䶿]") -> Column:
    both = lambda x: F.struct(F.regexp_count(x, F.lit(letter)).alias("own"), F.regexp_count(x, F.lit("[A-Za-z]")).alias("latin"))
    return let(let(c, both), lambda n: n["own"] / F.greatest(F.lit(1), n["own"] + n["latin"]))


def clean_markdown(c: Column) -> Column:
    """Prose of a markdown body: blocks of code and media, images and tags go; links leave their anchors; markup lines become blank."""
    for pattern, to in (
        (r"(?s)```.*?```", "\n\n"),
        (r"(?is)<(script|style|iframe|video|audio)\b.*?</\1>", "\n\n"),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"<[^>]+>", ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    line = lambda x: F.when(x.rlike(r"(?dU)^\s*(#{1,6}\s|\|.*\|\s*\z|>|([-*_]\s*){3,}\z)"), F.lit("")).otherwise(F.regexp_replace(x, r"(?U)\s+\z", ""))
    return F.array_join(F.transform(F.split(c, "\n"), line), "\n")


def normalize_marks(c: Column) -> Column:
    return F.translate(c, *MARKS)


def numbers(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?U){NUMBER}"), F.lit(0)))


def number_key(d: Column) -> Column:
    """`%.5e` of a number as C and Python print it: by its exact value, halves to the even digit.

    The JVM rounds the shortest decimal form, halves up. The two differ only where that form has seven digits, the last
    a 5; there the number is set against the half without error (up to 22 zeros) and moved off it.
    """

    def moved(long: Column) -> Column:
        m, e = F.replace(F.substring(long, 1, 8), F.lit("."), F.lit("")).cast("double"), F.substring(long, 10, 5).cast("int") - 6
        power = F.get(F.array(*[F.lit(float(10**i)) for i in range(23)]), F.abs(e))

        def half(x: Column) -> Column:
            side = F.when(e < 0, (x["p"] - m) + x["low"]).otherwise((d - x["p"]) - x["low"])
            down = (side < 0) | ((side == 0) & (F.floor(m / 10) % 2 == 0))
            return d * F.when(down, 1 - 2e-8).when(side.isNotNull(), 1 + 2e-8).otherwise(1.0)

        return F.when(F.substring(long, 8, 1).eqNullSafe("5") & (long.cast("double") == d), let(_product(F.when(e < 0, d).otherwise(m), power), half)).otherwise(d)

    short = (d < 1e6) & (d == F.floor(d))
    return F.format_string("%.5e", F.when(short, d).otherwise(let(F.format_string("%.6e", d), moved)))


def _product(a: Column, b: Column) -> Column:
    """struct<p, low>: a * b as the nearest double and what that leaves, by halves of 26 bits (Dekker)."""

    def split(x: Column) -> tuple[Column, Column]:
        high = x * 134217729.0 - (x * 134217729.0 - x)
        return high, x - high

    (a1, a2), (b1, b2) = split(a), split(b)
    return F.struct((a * b).alias("p"), (a2 * b2 - (((a * b - a1 * b1) - a2 * b1) - a1 * b2)).alias("low"))


def number_values(c: Column) -> Column:
    """Numbers by value, six significant digits, as keys."""
    found = F.regexp_extract_all(F.translate(c, FULL_DIGITS, "0123456789"), F.lit(GROUPED), F.lit(0))
    values = F.transform(found, lambda n: F.replace(n, F.lit(","), F.lit("")).cast("double"))
    return F.array_distinct(F.transform(values, number_key))


def listed_values(c: Column) -> Column:
    """number_values() without the markers of enumerations: a draft may turn a list into prose."""
    return number_values(F.regexp_replace(c, LIST_MARKER, " "))


def tokens(c: Column) -> Column:
    """Latin tokens, lower case, without dots and dashes at their ends."""
    found = F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))
    return F.array_distinct(F.transform(found, lambda w: F.regexp_replace(F.lower(w), r"^[.-]+|[.-]+\z", "")))


def excused(n: Column, other: Column, profile: Profile) -> Column:
    """A small number may stand in the other text as a numeral."""
    out = F.lit(False)
    for digit, glyphs in profile.numerals.items():
        out = out | ((n == digit) & other.rlike(f"[{glyphs}]"))
    return out


def fact_diff(original: Column, rewrite: Column, profile: Profile = HAN) -> Column:
    """struct<numbers, tokens>: numbers dropped or invented, and tokens invented."""
    held = F.struct(numbers(original).alias("a"), numbers(rewrite).alias("b"), tokens(original).alias("ta"), tokens(rewrite).alias("tb"))

    def diff(h: Column) -> Column:
        dropped = F.filter(F.array_except(h["a"], h["b"]), lambda n: ~excused(n, rewrite, profile))
        invented = F.filter(F.array_except(h["b"], h["a"]), lambda n: ~excused(n, original, profile))
        return F.struct(F.array_union(dropped, invented).alias("numbers"), foreign(h["ta"], h["tb"]).alias("tokens"))

    return let(held, diff)


def foreign(own: Column, new: Column) -> Column:
    """New tokens that neither hold nor lie in one of the own."""
    return F.filter(F.array_except(new, own), lambda w: ~F.exists(own, lambda x: F.contains(x, w) | F.contains(w, x)))


def number_drift(original: Column, rewrite: Column, profile: Profile = HAN) -> Column:
    """Numbers by value that only one text has, but for numerals and years written short."""

    def year(n: Column, others: Column) -> Column:
        v = n.cast("double")
        return ((v >= 0) & (v < 100) & F.array_contains(others, number_key(v + 2000))) | ((v >= 2000) & (v < 2100) & F.array_contains(others, number_key(v - 2000)))

    def small(n: Column, other: Column) -> Column:
        v = n.cast("double")
        # only one to ten have numerals, and a number may be beyond any integer
        return (v <= 10) & (v == F.floor(v)) & excused(F.least(v, F.lit(11.0)).cast("int").cast("string"), other, profile)

    def drift(h: Column) -> Column:
        lost = F.filter(F.array_except(h["a"], h["b"]), lambda n: ~small(n, rewrite) & ~year(n, h["b"]))
        new = F.filter(F.array_except(h["b"], h["a"]), lambda n: ~small(n, original) & ~year(n, h["a"]))
        return F.array_union(lost, new)

    return let(F.struct(number_values(original).alias("a"), number_values(rewrite).alias("b")), drift)


def user_message(instruction: str | Column, previous: Column, text: Column) -> Column:
    first = F.lit(instruction) if isinstance(instruction, str) else instruction
    before = F.when(previous != "", F.concat(F.lit("【上文（仅供参考，不要改写）】\n"), previous))
    return F.concat_ws("\n\n", first, before, F.concat(F.lit("【要改写的段落】\n"), text))


def token_budget(text: Column, factor: float = 1.6, extra: int = 64, most: int = 2048) -> Column:
    return F.least(F.lit(most), (F.length(text) * factor).cast("int") + extra)


def clean_output(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?s)<think>.*?</think>", "")
    c = F.regexp_replace(strip(c), r"^【改写后[^】]*】\s*", "")
    return F.trim(F.regexp_replace(strip(c), '^["“”]+|["“”]+\\z', ""))


def base_prompt(c: Column) -> Column:
    return F.split_part(c, F.lit("@"), F.lit(1))


def source_family(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("@")), F.split_part(c, F.lit("@"), F.lit(2))).otherwise("first")


def band(p: Column, cuts: tuple[float, float, float] = (0.3, 0.5, 0.85)) -> Column:
    if len(cuts) != 3 or list(cuts) != sorted(cuts):
        raise ValueError("three cuts in ascending order are needed")
    return F.when(p < cuts[0], 1).when(p < cuts[1], 2).when(p < cuts[2], 3).otherwise(4)


def links(c: Column) -> Column:
    pattern = F.lit(r"(?<!!)\[([^\]]+)\]\(([^)]+)\)")
    return F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("anchor"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("url"))


def plain(c: Column) -> Column:
    return F.regexp_replace(c, r"(?<!!)\[([^\]]+)\]\(([^)]+)\)", "$1")


def slugify(c: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(c, r"[^A-Za-z0-9_-]+", "-"), F.lit("-")), F.lit("")), F.lit("eval"))


def grams(c: Column, sizes: tuple[int, ...]) -> Column:
    """Character n-grams of all sizes, in order of size; linear in the text."""
    one = F.filter(F.split(c, ""), lambda x: x != "")
    parts, made = [], one
    for n in range(1, max(sizes) + 1):
        if n > 1:
            made = F.filter(F.zip_with(made, F.slice(one, n, F.size(one) + 1), lambda a, b: F.concat(a, b)), lambda x: x.isNotNull())
        if n in sizes:
            parts.append(made)
    return F.concat(*parts)


def hits(text: Column, marker: Column) -> Column:
    """Occurrences of a marker that don't overlap."""
    return (F.length(text) - F.length(F.replace(text, marker, F.lit("")))) / F.length(marker)


def total_hits(text: Column, markers: list[str] | tuple[str, ...]) -> Column:
    """Occurrences of all markers: one fold over an array, as a sum of hundreds of terms makes too deep an expression."""
    if not markers:
        return F.lit(0.0)
    return F.aggregate(F.array(*map(F.lit, markers)), F.lit(0.0), lambda a, m: a + hits(text, m))
