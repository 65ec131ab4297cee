"""Column functions on transcript text.

Everything here is a built-in expression: it stays in the scan stage, needs no
shuffle and no Python worker. Offsets and lengths count code points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# Characters that Unicode-aware strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regular-expression class (Java syntax).
WS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

DEFAULT_FILLERS = (
    "嗯", "啊", "那个", "这个", "就是", "然后", "反正",
    "就是说", "对吧", "是吧", "其实", "基本上",
    "那么", "的话", "的时候", "的话呢",
)
CN_DIGITS = {"零": 0, "一": 1, "二": 2, "三": 3, "四": 4, "五": 5,
             "六": 6, "七": 7, "八": 8, "九": 9, "两": 2}
CN_SMALL_UNITS = {"十": 10, "百": 100, "千": 1000}
CN_LARGE_UNITS = {"万": 10_000, "亿": 100_000_000}
CN_NUMERAL_CHARS = "".join([*CN_DIGITS, *CN_SMALL_UNITS, *CN_LARGE_UNITS])

QUESTIONS_PER_1000 = 1.5
TIER_BOUNDS = (("small", 1000), ("medium", 5000))
TIER_TOP = "large"

TIME_OF_DAY = "\\p{Nd}{2}:\\p{Nd}{2}:\\p{Nd}{2}"
SPEAKER_LABEL = "(?md)^([^:\\n]+):" + WS + "*$"

CJK_CLASSES = "\\u4e00-\\u9fff\\u3400-\\u4dbf\\u2e80-\\u2eff\\u3000-\\u303f\\uff00-\\uffef"


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def chars(c: Column) -> Column:
    """Array of code points; the empty string gives an empty array."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def slice_text(text: Column, start: Column, length: Column) -> Column:
    """``text[start : start + length]`` with a zero-based start."""
    return F.substring(text, start + 1, F.greatest(length, F.lit(0)))


# ------------------------------------------------------------------- cleaning
def remove_fillers(c: Column, fillers: Sequence[str] = DEFAULT_FILLERS) -> Column:
    """Delete filler words one after the other, in list order, then tidy spaces.

    The order matters: an earlier short filler eats part of a later long one.
    """
    out = reduce(lambda acc, f: F.replace(acc, F.lit(f), F.lit("")), fillers, c)
    out = F.regexp_replace(out, "  +", " ")
    return strip(F.regexp_replace(out, "\n{3,}", "\n\n"))


def merge_speaker_text(c: Column) -> Column:
    """Join consecutive blocks of one ``label:`` line inside a single text.

    Labels and bodies are two parallel arrays, so a body only has to look at
    the label before it: no fold is needed.
    """
    labels = F.transform(F.regexp_extract_all(c, F.lit(SPEAKER_LABEL), F.lit(1)), strip)
    pieces = F.split(c, SPEAKER_LABEL)

    def build(parts: Column) -> Column:
        names, texts = parts["names"], parts["texts"]
        preface = F.get(texts, F.lit(0))

        def block(name: Column, i: Column) -> Column:
            body = strip(F.get(texts, i + 1))
            opening = F.when((i == 0) & (preface == ""), F.lit("")).otherwise(F.lit("\n\n"))
            repeated = (i > 0) & (F.get(names, i - 1) == name)
            return F.when(repeated, body).otherwise(F.concat(opening, name, F.lit(":\n"), body))

        return F.concat(preface, F.array_join(F.transform(names, block), ""))

    merged = let(F.struct(labels.alias("names"), pieces.alias("texts")), build)
    return F.when(is_blank(c) | ~c.rlike(SPEAKER_LABEL), c).otherwise(merged)


# ------------------------------------------------------------------- numerals
def _numeral_value(run: Column) -> Column:
    """Value of a run of numeral characters, by a fold over (total, section, digit).

    Small units close a digit into the section, large units close the section
    into the total. Each character becomes one weight: digits as they are,
    units by their size.
    """
    weights = {**CN_DIGITS, **CN_SMALL_UNITS, **CN_LARGE_UNITS}
    codes = "".join(chr(ord("A") + i) for i in range(len(weights)))
    table = F.array(*[F.lit(int(w)).cast("long") for w in weights.values()])
    values = F.transform(F.split(F.translate(run, "".join(weights), codes), ""),
                         lambda ch: F.get(table, F.ascii(ch) - ord("A")))

    def state(total, section, digit):
        return F.struct(total.cast("long").alias("total"), section.cast("long").alias("section"),
                        digit.cast("long").alias("digit"))

    zero = F.lit(0).cast("long")
    least_large = min(CN_LARGE_UNITS.values())

    def step(acc: Column, w: Column) -> Column:
        section = acc["section"] + acc["digit"]
        return (
            F.when(w < 10, state(acc["total"], acc["section"], w))
            .when(w < least_large, state(
                acc["total"], acc["section"] + F.greatest(acc["digit"], F.lit(1)) * w, zero))
            .otherwise(state(acc["total"] + F.when(section == 0, 1).otherwise(section) * w, zero, zero)))

    return F.aggregate(values, state(zero, zero, zero), step,
                       lambda acc: F.nullif(acc["total"] + acc["section"] + acc["digit"], zero))


def chinese_numeral(c: Column) -> Column:
    """Value of a Chinese numeral; NULL for zero, other characters or nothing."""
    return F.when(c.rlike(f"^[{CN_NUMERAL_CHARS}]+\\z"), _numeral_value(c))


def normalize_numbers(c: Column) -> Column:
    """Annotate each run of two or more numeral characters with its value."""
    run = f"[{CN_NUMERAL_CHARS}]{{2,}}"

    def rewrite(parts: Column) -> Column:
        def annotate(raw: Column, i: Column) -> Column:
            value = _numeral_value(raw)
            noted = F.concat(value.cast("string"), F.lit("[原:"), raw, F.lit("]"))
            return F.concat(F.coalesce(noted, raw), F.get(parts["rest"], i + 1))

        return F.concat(F.get(parts["rest"], F.lit(0)),
                        F.array_join(F.transform(parts["runs"], annotate), ""))

    parts = F.struct(F.regexp_extract_all(c, F.lit(run), F.lit(0)).alias("runs"),
                     F.split(c, run).alias("rest"))
    return F.when(c.rlike(run), let(parts, rewrite)).otherwise(c)


# -------------------------------------------------------------- classification
def citation_style(c: Column) -> Column:
    return F.when(c.rlike(TIME_OF_DAY), "timestamp").otherwise("paragraph")


def transcript_type(c: Column) -> Column:
    """``qa`` when question marks reach 1.5 per thousand characters."""
    density = F.regexp_count(c, F.lit("[？?]")) * 1000 / F.greatest(F.length(c), F.lit(1))
    return F.when(F.coalesce(density, F.lit(0.0)) < QUESTIONS_PER_1000, "narration").otherwise("qa")


def size_tier(c: Column) -> Column:
    expr = F
    for name, bound in TIER_BOUNDS:
        expr = expr.when(F.length(c) < bound, name)
    return expr.otherwise(TIER_TOP)


# --------------------------------------------------------------------- scripts
def is_han(c: Column) -> Column:
    """Every character is a Han ideograph (punctuation is not)."""
    return c.rlike("^[\\u4e00-\\u9fff]+$")


def has_cjk(c: Column) -> Column:
    """Some character is CJK, full-width punctuation included."""
    return c.rlike(f"[{CJK_CLASSES}]")


def same_script(a: Column, b: Column) -> Column:
    return has_cjk(a) == has_cjk(b)


def edit_distance(a: Column, b: Column) -> Column:
    """Case-insensitive edit distance; a length gap over two counts as three."""
    return F.when(F.abs(F.length(a) - F.length(b)) > 2, 3).otherwise(
        F.levenshtein(F.lower(a), F.lower(b)))


# ------------------------------------------------------------ snippets, secrets
def context_snippet(text: Column, start: Column, end: Column, width: int = 12) -> Column:
    """``left【match】right`` around a zero-based half-open range, on one line."""
    left_from = F.greatest(start - width, F.lit(0))
    left = slice_text(text, left_from, start - left_from)
    joined = F.concat(left, F.lit("【"), slice_text(text, start, end - start), F.lit("】"),
                      slice_text(text, end, F.lit(width)))
    return F.translate(joined, "\n", " ")


def redact_secrets(c: Column) -> Column:
    """Hide the body of API keys; what introduces the key stays readable."""
    out = F.regexp_replace(c, "sk-[A-Za-z0-9]{20,}", "sk-***")
    return F.regexp_replace(
        out, "(?i)(api[_-]?key['\"]?" + WS + "*[:=]" + WS + "*['\"]?)[A-Za-z0-9_\\-]{16,}", "$1***")


def mask_key(c: Column) -> Column:
    """Known key prefix and the last three characters; anything else is hidden."""
    masked = F
    for prefix in ("gsk_", "sk-or-", "sk-"):
        tail = F.substring(c, F.lit(len(prefix) + 1), F.length(c))
        shown = F.when(F.length(tail) <= 3, "").otherwise(F.right(tail, F.lit(3)))
        masked = masked.when(c.startswith(prefix), F.concat(F.lit(prefix + "***"), shown))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(masked.otherwise("***"))


def truncate_text(c: Column, n: int = 100) -> Column:
    cut = F.concat(F.substring(c, 1, n), F.lit("... (truncated "),
                   (F.length(c) - n).cast("string"), F.lit(" chars)"))
    return F.when(F.length(c) > n, cut).otherwise(c)
