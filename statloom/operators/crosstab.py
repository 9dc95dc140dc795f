"""Contingency tables and the chi-square test; details are counted once, everything else is on the counts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalars import effect_label, p_text, r4, stars
from statloom.functions.tails import chi2_upper
from statloom.operators.naming import plain_names
from statloom.operators.skew import every_pair, lookup_by_key, null_safe_join
from statloom.session import settle


@plain_names("var1", "var2", "by")
def counts(df: DataFrame, var1: str, var2: str, by: list[str] = ()) -> DataFrame:
    return (df.where(F.col(var1).isNotNull() & F.col(var2).isNotNull())
            .groupBy(*by, F.col(var1).alias("v1"), F.col(var2).alias("v2")).agg(F.count("*").alias("n")))


@plain_names("var1", "var2")
def with_margins(df: DataFrame, var1: str, var2: str) -> DataFrame:
    """Cells, row totals, column totals and the grand total in long form."""
    cells = counts(df, var1, var2)
    label = lambda c, text: F.when(F.grouping(c) == 1, F.lit(text)).otherwise(F.col(c).cast("string"))
    cube = cells.cube("v1", "v2").agg(F.sum("n").alias("n"), label("v1", "Col Total").alias("row_label"),
                                      label("v2", "Row Total").alias("col_label"))
    return cube.select("row_label", "col_label", "n")


@plain_names("var1", "var2")
def wide(df: DataFrame, var1: str, var2: str, levels: list | None = None) -> DataFrame:
    """One row per level of the first variable, one column per level of the second."""
    return counts(df, var1, var2).groupBy("v1").pivot("v2", levels).agg(F.sum("n")).na.fill(0)


def grid(cells: DataFrame, by: list[str] = ()) -> DataFrame:
    """Every level pair, absent ones with zero, with row, column and grand totals and the expected count.

    The result has a row per pair of levels, as it must; levels meet in spread joins of the counted margins.
    """
    by = list(by)
    rows = cells.groupBy(*by, "v1").agg(F.sum("n").alias("row_n"))
    cols = cells.groupBy(*by, "v2").agg(F.sum("n").alias("col_n"))
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"))
    pairs = every_pair(rows, cols, by)
    pairs = lookup_by_key(pairs, total, by) if by else pairs.withColumn("total", total.scalar())
    full = null_safe_join(pairs, cells, [*by, "v1", "v2"], "left")
    expected = F.col("row_n") * F.col("col_n") / F.col("total")
    return full.select(*by, "v1", "v2", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "row_n", "col_n", "total",
                       expected.alias("expected"))


@plain_names("var1", "var2", "by")
def residuals(df: DataFrame, var1: str, var2: str, by: list[str] = ()) -> DataFrame:
    """Observed, expected and standardised residual of every cell."""
    g = grid(settle(counts(df, var1, var2, by)), by)
    return g.withColumn("residual", (F.col("n") - F.col("expected")) / F.sqrt("expected"))


@plain_names("var1", "var2")
def row_percents(df: DataFrame, var1: str, var2: str) -> DataFrame:
    cells = settle(counts(df, var1, var2))
    rows = cells.groupBy("v1").agg(F.sum("n").alias("row_n"))
    return lookup_by_key(cells, rows, ["v1"]).select("v1", "v2", "n", (F.col("n") * 100.0 / F.col("row_n")).alias("percent"))


@plain_names("var1", "var2", "by")
def chi_square(df: DataFrame, var1: str, var2: str, by: list[str] = ()) -> DataFrame:
    """Chi-square of independence (continuity-corrected at one degree of freedom) with Cramér's V.

    Works on the observed cells alone: an absent cell adds its expected count, and all absent cells together
    add what the observed ones leave of the total. So the level grid is never built. Level totals are aggregated and
    looked up, so a level with half of all cells is not one task's.
    """
    by = list(by)
    cells = settle(counts(df, var1, var2, by))
    total = cells.groupBy(*by).agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    rows = cells.groupBy(*by, "v1").agg(F.sum("n").alias("rn"), (1.0 / F.count("*")).alias("rw"))
    cols = cells.groupBy(*by, "v2").agg(F.sum("n").alias("cn"), (1.0 / F.count("*")).alias("cw"))
    if by:
        cells = lookup_by_key(cells, total, by)
    else:
        cells = cells.withColumns({c: total.select(c).scalar() for c in ("total", "held")})
    cells = lookup_by_key(lookup_by_key(cells, rows, [*by, "v1"]), cols, [*by, "v2"])
    expected = F.col("rn") * F.col("cn") / F.col("total")
    gap = F.abs(F.col("n") - expected)
    agg = cells.groupBy(*by).agg(
        F.max("total").alias("n"), F.max("held").alias("_held"),
        F.round(F.sum("rw")).cast("long").alias("_r"), F.round(F.sum("cw")).cast("long").alias("_c"),
        F.sum(gap * gap / expected).alias("_seen"), F.sum(expected).alias("_seen_e"), F.max(gap).alias("_gap"),
        F.sum(F.col("rw") / F.col("rn")).alias("_inv_r"), F.sum(F.col("cw") / F.col("cn")).alias("_inv_c"),
        (F.min("rn") * F.min("cn") / F.max("total")).alias("min_expected"))
    r, c = F.col("_r"), F.col("_c")
    dof = (r - 1) * (c - 1)
    absent = F.when(F.col("_held") < r * c, F.col("n") - F.col("_seen_e")).otherwise(F.lit(0.0))
    cut = F.col("_gap") - F.least(F.lit(0.5), F.col("_gap"))
    corrected = cut * cut * F.col("n") * F.col("_inv_r") * F.col("_inv_c")
    out = agg.select(*by, F.when(dof == 1, corrected).otherwise(F.col("_seen") + absent).alias("chi2"),
                     dof.alias("dof"), "n", "min_expected", F.greatest(F.least(r, c) - 1, F.lit(1)).alias("_dim"))
    p = F.when(F.col("dof") == 0, F.lit(1.0)).otherwise(chi2_upper("chi2", F.col("dof").cast("double")))
    return (out.withColumn("p_value", p)
            .withColumn("cramers_v", F.sqrt(F.col("chi2") / (F.col("n") * F.col("_dim"))))
            .withColumn("effect_size", effect_label("cramers_v", F.col("cramers_v")))
            .withColumn("significance", stars(F.col("p_value"))).withColumn("p_display", p_text(F.col("p_value")))
            .drop("_dim"))


@plain_names("var1", "var2")
def expected_table(df: DataFrame, var1: str, var2: str) -> DataFrame:
    return residuals(df, var1, var2).select("v1", "v2", "n", r4("expected").alias("expected"))
