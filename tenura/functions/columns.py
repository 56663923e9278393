"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The cleaning and range rules of the survival table.
MIN_TEXT_CHARS = 20
MIN_DURATION = 0.5
MAX_DURATION = 5000.0
MINUTES_PER_HOUR = 60.0

# Fixed value: a word is two or more letters, digits or underscores, in any script.
WORD = r"[\p{L}\p{N}_]{2,}"


def field_or(column: Column | str, default) -> Column:
    """A field, or its default where the record lacks it."""
    return F.coalesce(_col(column), F.lit(default))


def stripped(column: Column | str) -> Column:
    """Text without leading and trailing whitespace of any kind (`trim` removes spaces only)."""
    return F.regexp_replace(_col(column), r"(?U)^\s+|\s+$", "")


def hours(column: Column | str) -> Column:
    """Minutes to hours, a missing value counts as zero."""
    return field_or(_col(column).cast("double"), 0.0) / F.lit(MINUTES_PER_HOUR)


def log1p_or_zero(column: Column | str) -> Column:
    return F.log1p(field_or(_col(column).cast("double"), 0.0))


def words(text: Column | str) -> Column:
    """Lower-case words of a text; a missing text has none."""
    return F.regexp_extract_all(F.lower(field_or(text, "")), F.lit(WORD), F.lit(0))


def unigrams_and_bigrams(tokens: Column) -> Column:
    """Words followed by the pairs of neighbouring words.

    The words are bound to a lambda variable, as in `unit_length`: they are found once, not at every mention.
    """
    pairs = lambda t: F.transform(
        F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0))),
        lambda left, i: F.concat_ws(" ", left, F.get(t, i + 1)),
    )
    return F.element_at(F.transform(F.array(tokens), lambda t: F.concat(t, pairs(t))), 1)


def literal_array(values: Sequence, kind: str) -> Column:
    """A long array constant: one string literal that the optimizer turns into an array once."""
    return F.split(F.lit(",".join(repr(v) for v in values)), ",").cast(f"array<{kind}>")


def unit_length(values: Column) -> Column:
    """A numeric array scaled to length 1; a zero array stays as it is.

    The array and its length are bound to lambda variables: a plain column would be inlined into
    the inner lambda and computed again for every element.
    """
    scaled = F.transform(
        F.array(values),
        lambda v: F.aggregate(
            v,
            F.lit(0.0),
            lambda total, x: total + x * x,
            lambda total: F.transform(v, lambda x: F.when(total > 0, x / F.sqrt(total)).otherwise(x)),
        ),
    )
    return F.element_at(scaled, 1)


def order_hash(keys: Sequence[str], seed: int) -> Column:
    """A seeded, engine-independent shuffle order: the md5 of the row key and the seed."""
    parts = [F.col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def log10_evidence(p: Column | str) -> Column:
    """-log10(p), with p held above 1e-30 so that the value stays finite."""
    return -F.log10(F.greatest(_col(p), F.lit(1e-30)))


def linear_predictor(coef: dict[str, float], means: dict[str, float] | None = None) -> Column:
    """sum of coef * (x - mean) over the features."""
    total = F.lit(0.0)
    for name, value in coef.items():
        x = F.col(name).cast("double")
        if means is not None:
            x = x - F.lit(float(means[name]))
        total = total + F.lit(float(value)) * x
    return total


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column
