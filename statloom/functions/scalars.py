"""Scalar column expressions: significance texts, effect labels, display formats."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom import fixed_values as fv


def r4(c) -> Column:
    return F.round(c, 4)


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stars(p: Column) -> Column:
    out = reduce(lambda acc, cut: acc.when(p < cut[0], cut[1]), fv.STAR_CUTS[1:],
                 F.when(p < fv.STAR_CUTS[0][0], fv.STAR_CUTS[0][1]))
    return F.when(p.isNotNull(), out.otherwise("ns"))


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, F.lit("p < .001")).when(p.isNotNull(), F.format_string("p = %.3f", p))


def p_report(p: Column) -> Column:
    """Report cell: the comparison sign without the leading letter, a dash when there is no p."""
    return F.when(p.isNull(), F.lit("—")).when(p < 0.001, F.lit("< .001")).otherwise(F.format_string("= %.3f", p))


def verdict(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < alpha, "statistically significant").when(p.isNotNull(), "not statistically significant")


def decision(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < alpha, "reject").when(p.isNotNull(), "fail to reject")


def effect_label(kind: str, value: Column) -> Column:
    """Label of an effect size by the cut points of its kind; signed effects use their size."""
    cuts, top = fv.EFFECT_CUTS[kind]
    size = value if kind == "alpha" else F.abs(value)
    out = reduce(lambda acc, cut: acc.when(size < cut[0], cut[1]), cuts[1:], F.when(size < cuts[0][0], cuts[0][1]))
    return F.when(value.isNotNull(), out.otherwise(top))


def strength_text(r: Column) -> Column:
    return F.concat(F.when(r > 0, "positive ").otherwise("negative "), effect_label("correlation", r))


def skew_label(skew: Column) -> Column:
    return (F.when(F.abs(skew) < fv.SKEW_CUT, "approximately symmetric")
            .when(skew > 0, "positively skewed").when(skew.isNotNull(), "negatively skewed"))


def effect_text(label: Column | None = None, **effects: Column) -> Column:
    """First effect that is present, as `name = value`, with the label in brackets when given."""
    names = {"cohens_d": "Cohen's d", "cramers_v": "Cramér's V", "eta_squared": "η²", "r_squared": "R²",
             "effect_r": "r"}
    tail = F.lit("") if label is None else F.concat(F.lit(" ("), F.coalesce(label, F.lit("")), F.lit(")"))
    parts = [F.when(effects[k].isNotNull(), F.concat(F.lit(f"{n} = "), effects[k].cast("string"), tail))
             for k, n in names.items() if k in effects]
    return F.coalesce(*parts, label if label is not None else F.lit("—"), F.lit("—"))


def headline_chips(p: Column, n: Column | None = None, **effects: Column) -> Column:
    """At most six (label, value) chips, only for the values that are present."""
    names = {"r_squared": "R²", "cohens_d": "Cohen's d", "cramers_v": "Cramér's V", "eta_squared": "η²"}

    def chip(label, value):
        return F.when(value.isNotNull(), F.struct(F.lit(label).alias("label"), value.cast("string").alias("value")))

    chips = [chip("p-value", p_text(p)), chip("Significance", stars(p))]
    chips += [chip(names[k], effects[k]) for k in names if k in effects]
    if n is not None:
        chips.append(chip("Sample (N)", n))
    return F.slice(F.array_compact(F.array(*chips)), 1, 6)


def strip_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"(?d)\*\*(.+?)\*\*", "$1")


def guard_formula(text: Column) -> Column:
    """A leading quote keeps spreadsheets from evaluating the cell."""
    return F.when(text.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), text)).otherwise(text)


def display_text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("NaN"))


def format_price(usd: Column, currency: Column, converted: Column, prefix: Column) -> Column:
    """Local amount with the dollar amount behind it; whole amounts carry no decimals."""
    whole = usd == F.floor(usd)
    trimmed = F.regexp_replace(F.regexp_replace(F.format_number(usd, 2), r"0+$", ""), r"\.$", "")
    plain_usd = F.concat(F.lit("$"), F.floor(usd).cast("string"))
    usd_only = F.when(whole, plain_usd).otherwise(F.concat(F.lit("$"), trimmed))
    usd_tail = F.when(whole, plain_usd).otherwise(F.concat(F.lit("$"), F.format_number(usd, 2)))
    local = F.when(currency == "NGN", F.format_number(converted, 0)).otherwise(F.format_number(converted, 2))
    symbol = F.coalesce(prefix, F.concat(currency, F.lit(" ")))
    return F.when(currency == "USD", usd_only).otherwise(
        F.concat(symbol, local, F.lit(" (~"), usd_tail, F.lit(")")))
