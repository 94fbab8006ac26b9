"""Score normalisation and the factors of a source's weight."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of letter grades.
GRADES = {
    "A+": 97, "A": 90, "A-": 87, "B+": 83, "B": 80, "B-": 77, "C+": 73, "C": 70, "C-": 67, "D+": 63, "D": 60, "D-": 57, "F": 40,
}
#: Factors of the scales that have a name.
SCALES = ((100.0, 1.0, "scale_100"), (10.0, 10.0, "scale_10"), (5.0, 20.0, "scale_5"), (4.0, 25.0, "scale_4_star"))
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def clamp(x: Column, lo: float, hi: float) -> Column:
    """Null stays null; NaN counts as above all numbers."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def number(text: Column) -> Column:
    """A plain decimal number, or null: no suffixes, no separators."""
    bare = stripped(text)
    return F.when(bare.rlike(NUMBER), bare.try_cast("double"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(text, F.lit(" \t\n\r\f\u000b"))


def normalized(value: Column, scale: Column, kind: Column | None = None) -> Column:
    """struct(score, type, rule) of a score as text: letters, fractions, then numbers on their scale."""
    text = stripped(value)
    given = F.struct(
        text.alias("text"), F.upper(text).alias("letter"), number(text).alias("amount"), F.split(text, "/", 3).alias("parts"),
        scale.cast("double").alias("scale"), (kind if kind is not None else F.lit(None).cast("string")).alias("kind"),
    )
    # inside a lambda the parts are columns of their own, so each is computed once, not wherever it is written
    return F.get(F.transform(F.array(given), _normalized), F.lit(0))


def _normalized(g: Column) -> Column:
    text, letter, amount, scale = g["text"], g["letter"], g["amount"], g["scale"]
    grades = F.create_map(*(F.lit(x) for name, p in GRADES.items() for x in (name, float(p))))
    grade = F.try_element_at(grades, letter)
    top, bottom = number(F.get(g["parts"], F.lit(0))), number(F.get(g["parts"], F.lit(1)))
    none = lambda rule: F.struct(F.lit(None).cast("double").alias("score"), F.lit("non_numeric").alias("type"), F.lit(rule).alias("rule"))
    got = lambda x, how, rule: F.struct(clamp(x, 0.0, 100.0).alias("score"), F.lit(how).alias("type"), rule.alias("rule"))
    fraction = F.struct(top.alias("top"), bottom.alias("bottom"))
    of_fraction = F.get(F.transform(F.array(fraction), lambda f: F.when(
        (F.size(g["parts"]) == 2) & f["top"].isNotNull() & (f["bottom"] > 0), got(f["top"] / f["bottom"] * 100, "fraction", F.concat(F.lit("fraction:"), text)),
    ).otherwise(none("unparseable_fraction"))), F.lit(0))
    out = F.when(text.isNull() | (text == ""), none("empty_value"))
    out = out.when((F.length(text) <= 2) & grade.isNotNull(), got(grade, "letter", F.concat(F.lit("letter:"), letter)))
    out = out.when((F.length(text) <= 2) & letter.rlike("^[ABCDF][+-]?$"), none("unknown_letter"))
    out = out.when(text.contains("/"), of_fraction)
    out = out.when(amount.isNull(), none("unparseable_value"))
    for size, factor, rule in SCALES:
        out = out.when(scale == size, got(amount * factor, "numeric", F.lit(rule)))
    out = out.when(scale > 0, got(amount / scale * 100, "numeric", F.lit("scale_custom")))
    out = out.when(g["kind"] == "non_numeric", none("pre_marked_non_numeric"))
    return out.otherwise(none("no_scale_info"))


def sample_confidence(n: Column) -> Column:
    return clamp(0.6 + 0.5 * F.least(F.lit(1.0), F.log1p(n.cast("double")) / F.log(F.lit(5001.0))), 0.6, 1.1)


def discrimination_factor(power: Column) -> Column:
    return F.when(power.isNull(), 0.9).otherwise(clamp(0.7 + 0.3 * power, 0.7, 1.1))


def relevance(count: Column, n: Column, slope: float, most: float) -> Column:
    """1 without a context; else 0.8 plus a share of the source's reviews in it."""
    return F.when(count.isNull(), 1.0).otherwise(clamp(0.8 + slope * count / F.greatest(n, F.lit(1)), 0.8, most))


def band(score: Column) -> Column:
    return F.when(score >= 90, "outstanding").when(score >= 75, "great").when(score >= 60, "good").when(score >= 40, "mixed").when(score.isNotNull(), "weak")


def top_band(score: Column) -> Column:
    """The band of an item in the list of the best of all time."""
    return F.when(score >= 95, "legend").when(score >= 90, "classic").when(score >= 80, "strong").when(score.isNotNull(), "listed")


def one_decimal(x: Column) -> Column:
    """A number with one decimal, rounded by its exact binary value, exact halves away from zero; null of null.

    Ten times the number is eight and two times it, both exact; what their sum lost decides where it looks like a half.
    """
    size = F.abs(x)
    ten = size * 8 + size * 2
    lost = size * 2 - (ten - size * 8)
    over = ten - F.floor(ten)
    n = F.floor(ten) + F.when((over > 0.5) | ((over == 0.5) & (lost >= 0)), 1).otherwise(0)
    return F.concat(F.when(x < 0, "-").otherwise(""), F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def score_text(score: Column) -> Column:
    """One decimal, or N/A."""
    return F.coalesce(one_decimal(score), F.lit("N/A"))


def signed_text(x: Column) -> Column:
    """One decimal, with its sign."""
    return F.concat(F.when(x < 0, "").otherwise("+"), one_decimal(x))


def share_of(count: Column, total: Column) -> Column:
    """Percent of a total, 100 at most; null without a total."""
    return F.least(F.lit(100.0), F.try_divide(100.0 * count, total))


def top_entries(counts: Column, most: int = 15) -> Column:
    """A map's entries with the largest values first, of equal ones by key."""
    order = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).otherwise(1)
    return F.slice(F.array_sort(F.map_entries(counts), order), 1, most)


def count_of(counts: Column, key: Column) -> Column:
    """A map's value, 0 where it has none."""
    return F.coalesce(F.try_element_at(counts, key), F.lit(0))


def half_up_1(x: Column) -> Column:
    """One decimal, halves up."""
    return F.floor(x * 10 + 0.5) / 10


# The phrases of an explanation.
def weight_explanation(name: Column, genre: Column, platform: Column, n: Column, factor: Column, weight: Column) -> Column:
    """Who, in which context, from how many reviews; tiers of discrimination and of sample size; the weight."""
    where = F.concat(F.coalesce(F.concat(F.lit(" ("), genre, F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(" on "), platform), F.lit("")))
    spread = F.when(factor >= 1.0, "high").when(factor >= 0.85, "moderate").otherwise("low")
    size = (
        F.when(n >= 500, "large historical sample").when(n >= 100, "sufficient sample size")
        .when(n >= 30, "moderate sample size").otherwise("limited sample size")
    )
    return F.concat(
        name, where, F.lit(": "), n.cast("string"), F.lit(" historical reviews, "), spread, F.lit(" score discrimination, "), size,
        F.lit(" — final weight: "), F.format_string("%.2f", weight),
    )
