"""Column builders over text: pure expressions that stay inside the JVM, with the semantics of Python's str methods."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation that Unicode classes as symbols, not as punctuation.
ASCII_SYMBOLS = "$+<=>^`|~"
ARTICLES = ("a", "an", "the")
#: White space as Python's str.split() sees it.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(f: Callable[..., Column], *values: Column) -> Column:
    """f of values that are computed once, however often f uses them."""
    names = [f"v{k}" for k in range(len(values))]
    row = F.struct(*(v.alias(n) for v, n in zip(values, names, strict=True)))
    return F.element_at(F.transform(F.array(row), lambda r: f(*(r[n] for n in names))), 1)


def strip(c: Column | str) -> Column:
    """str.strip(): white space of any kind goes at both ends."""
    return F.regexp_replace(col(c), rf"^{BLANK}+|{BLANK}+$", "")


def split(c: Column | str) -> Column:
    """str.split(): the runs of characters that aren't white space."""
    return F.filter(F.split(col(c), f"{BLANK}+"), lambda t: t != "")


def squad_tokens(c: Column | str) -> Column:
    """Lower-case tokens without punctuation and articles; symbols outside ASCII stay."""
    bare = F.regexp_replace(F.lower(col(c)), r"[\p{P}$+<=>^`|~]", "")
    return split(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def quasi_normal(c: Column | str) -> Column:
    """Lower case; joiners go, other punctuation and articles become blanks, blanks are squeezed."""
    joined = F.translate(F.lower(col(c)), "‌‍", "")
    bare = F.regexp_replace(joined, r"(?U)[^\w\s]", " ")
    return F.array_join(split(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " ")), " ")


def word_tokens(c: Column | str) -> Column:
    """Lower-case words with joiners dropped and punctuation as white space: the tokens of the grounding scorers."""
    return split(F.regexp_replace(F.translate(F.lower(col(c)), "‌‍", ""), r"(?U)[^\w\s]", " "))


def strip_thinking(c: Column | str) -> Column:
    """The answer part of a reply: complete think blocks go, and all up to a last closing tag."""
    closed = F.regexp_replace(col(c), r"(?s)<think>(?:(?!<think>).)*?</think>", "")
    return F.substring_index(closed, "</think>", -1)


def fold_apostrophes(c: Column | str) -> Column:
    return F.translate(col(c), "’‘ʼ′", "''''")


def multiset_overlap(a: Column | str, b: Column | str) -> Column:
    """How many tokens two arrays share, each as often as it stands in both: one sort and one fold, no shuffle."""

    def tagged(tokens: Column, side: int) -> Column:
        return F.transform(tokens, lambda t: F.struct(t.alias("t"), F.lit(side).alias("side")))

    def state(t: Column, left: Column, right: Column, total: Column) -> Column:
        return F.struct(t.alias("t"), left.alias("left"), right.alias("right"), total.alias("total"))

    zero = F.lit(0).cast("long")

    def step(acc: Column, x: Column) -> Column:
        left, right = (x["side"] == 0).cast("long"), (x["side"] == 1).cast("long")
        return F.when(acc["t"].eqNullSafe(x["t"]), state(acc["t"], acc["left"] + left, acc["right"] + right, acc["total"])).otherwise(
            state(x["t"], left, right, acc["total"] + F.least(acc["left"], acc["right"]))
        )

    ordered = F.array_sort(F.concat(tagged(col(a), 0), tagged(col(b), 1)))
    return F.aggregate(ordered, state(F.lit(None).cast("string"), zero, zero, zero), step, lambda acc: acc["total"] + F.least(acc["left"], acc["right"]))


def rounded(c: Column | str, places: int = 6) -> Column:
    """A double to so many places as SQL engines round it: the product with 10 ** places to a whole number, halves away from zero.

    F.round rounds the shortest decimal that names the double instead, which differs where that is a half and the
    product is below it: 41 / 640 = 0.0640625 is 0.064062 here, and 0.064063 there.
    """
    scale = F.lit(float(10**places))
    return F.round(col(c) * scale) / scale


def count_of(c: Column | str) -> Column:
    return F.size(col(c)).cast("double")


def numbers(c: Column | str) -> Column:
    """Numbers of a text as they stand, with sign, thousands commas and decimals."""
    return F.regexp_extract_all(col(c), F.lit(r"-?\d[\d,]*(?:\.\d+)?"), F.lit(0))


def entropy(token: Column | str) -> Column:
    """Shannon entropy of a token's characters, in bits."""
    chars = F.split(col(token), "")
    n = F.size(chars)
    shares = F.transform(F.array_distinct(chars), lambda ch: F.size(F.filter(chars, lambda x: x == ch)) / n)
    return F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def digest(c: Column | str, length: int = 64) -> Column:
    """The first hex digits of a text's SHA-256."""
    return F.substring(F.sha2(col(c), 256), 1, length)


def json_path(c: Column | str, path: str) -> Column:
    """The value at a dotted path of a JSON text, as a string: keys, and [n] for items; null if there is none."""
    return F.get_json_object(col(c), f"$.{path}")


def shared(a: Column, b: Column) -> Column:
    """How many distinct tokens two arrays share."""
    return F.size(F.array_intersect(a, b))


def money(c: Column | str) -> Column:
    """The number of a text with a currency sign and thousands commas; null if it is none."""
    bare = F.replace(F.trim(col(c)), F.lit(","), F.lit(""))
    return F.regexp_replace(bare, r"^([+-]?)\s*[$€£₹]\s*", "$1").try_cast("double")


def date_of(c: Column | str, formats: list[str]) -> Column:
    """The date that a text is by the first of the formats (Spark's patterns) that fits; null if none does."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(col(c)), F.lit(f)) for f in formats)).cast("date")
