"""Text cells to values: trimming, null markers, numbers, dates, category case."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom import fixed_values as fv

_EDGE_SPACE = r"(?U)^[\s\u001c-\u001f]+|[\s\u001c-\u001f]+$"
_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_FLOAT = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"
_INFINITE = r"(?i)^[+-]?inf(inity)?$"


def strip_text(c: Column) -> Column:
    """Trim every kind of white space; the text `nan` counts as missing."""
    return F.nullif(F.regexp_replace(c, _EDGE_SPACE, ""), F.lit("nan"))


def null_markers(c: Column) -> Column:
    return F.when(c.isin(fv.NULL_MARKERS), None).otherwise(c)


def load_nulls(c: Column) -> Column:
    """The markers that already count as missing when a file is read."""
    return F.when(c.isin(fv.LOAD_NULLS), None).otherwise(c)


def clean_cell(c: Column) -> Column:
    return null_markers(strip_text(c))


def _with(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body`; keeps long case chains from repeating regexes."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _as_double(text: Column) -> Column:
    return F.when(text.rlike(_FLOAT), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("double"))


def _point_decimal(bare: Column) -> Column:
    """The text with its decimal mark as a point and its thousands marks gone."""
    n_comma = F.length(bare) - F.length(F.translate(bare, ",", ""))
    n_dot = F.length(bare) - F.length(F.translate(bare, ".", ""))
    after_comma = F.length(F.substring_index(bare, ",", -1))
    comma_is_last = after_comma < F.length(F.substring_index(bare, ".", -1))
    return (
        F.when((n_comma > 0) & (n_dot > 0) & comma_is_last, F.translate(F.translate(bare, ". ", ""), ",", "."))
        .when((n_comma > 0) & (n_dot > 0), F.translate(bare, ", ", ""))
        .when((n_comma == 1) & (after_comma != 3), F.translate(bare, ",", "."))
        .when(n_comma > 0, F.translate(bare, ", ", ""))
        .when((n_dot == 1) & bare.rlike(r"\.[\s\S]{3}$") & ~bare.rlike(_FLOAT), F.translate(bare, ". ", ""))
        .when(n_dot == 1, F.translate(bare, " ", ""))
        .otherwise(F.translate(bare, ". ", ""))
    )


def parse_number(c: Column) -> Column:
    """Number or currency text to double; commas and dots are told apart by position."""
    def bare(s):
        return F.translate(F.regexp_replace(F.translate(s, fv.CURRENCY_SYMBOLS, ""), _EDGE_SPACE, ""), "\u00a0", " ")

    def parsed(s):
        infinite = F.when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        return (F.when(s.isin(fv.NUMBER_NULL_TOKENS), None)
                .when(s.rlike(_PLAIN), s.try_cast("double"))
                .when(s.rlike(_INFINITE), infinite)
                .otherwise(_with(bare(s), lambda b: _as_double(_point_decimal(b)))))

    return _with(F.regexp_replace(c, _EDGE_SPACE, ""), parsed)


def to_number(c: Column, dtype: str) -> Column:
    """Strict numeric reading of a column: typed columns cast, text must be a plain number, NaN is missing."""
    if dtype == "string":
        s = F.regexp_replace(c, _EDGE_SPACE, "")
        return F.when(s.rlike(_PLAIN), s.try_cast("double"))
    if dtype in ("double", "float"):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if dtype in ("date", "boolean") or dtype.startswith(("timestamp", "array", "map", "struct", "binary", "interval")):
        return F.lit(None).cast("double")
    return c.cast("double")


def _shape(pattern: str) -> str:
    """Regex of the texts a date pattern can read at all."""
    out = pattern
    for token, regex in (("yyyy", r"\d{4}"), ("MMMM", "[A-Za-z]+"), ("MMM", "[A-Za-z]+"), ("MM", r"\d{2}"), ("dd", r"\d{2}"), ("mm", r"\d{2}"), ("ss", r"\d{2}")):
        out = out.replace(token, regex)
    return "^" + re.sub(r"(?<!\\)\b[MdH]\b", r"\\d{1,2}", out) + "$"


def parse_date(c: Column) -> Column:
    """First pattern that fits wins, day before month; long forms and date-times are the last resort.

    Texts are sorted by shape first: a pattern is only tried on texts of its shape, since failed parses are slow.
    """
    shapes: dict[str, list[str]] = {}
    for p in [*fv.DATE_PATTERNS, *fv.DATE_FALLBACK_PATTERNS]:
        shapes.setdefault(_shape(p), []).append(p)

    def parsed(s):
        iso = F.when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}[T ]|^\d{4}(-\d{1,2})?$"), F.to_date(s.try_cast("timestamp")))
        out = None
        for shape, patterns in shapes.items():
            tries = F.coalesce(*[F.to_date(F.try_to_timestamp(s, F.lit(p))) for p in patterns])
            out = F.when(s.rlike(shape), tries) if out is None else out.when(s.rlike(shape), tries)
        return out.otherwise(iso)

    return _with(F.regexp_replace(F.regexp_replace(c, _EDGE_SPACE, ""), r"\s+", " "), parsed)


def title_case(c: Column) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the others."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(0))
    return F.array_join(F.transform(runs, lambda x: F.initcap(x)), "")


def is_boolean_token(c: Column) -> Column:
    return F.lower(c).isin(fv.BOOLEAN_TOKENS)
