"""Operators take columns of any name, their own inner names included, and give the same figures."""

import pytest
from pyspark.sql import functions as F

from statloom.operators import chartdata, comparisons, correlation, crosstab, dedup, normality, outliers, profile, ranks, regression, summaries
from statloom.operators.naming import col
from statloom.plans import cleaning

NAMES = ["n", "a.b", "grp", "tie", "v1", "value", "q`x", "variable", "below", "rank"]


def table(spark, names):
    """x, y numeric, g of two, h of three levels, s a segment, under the given names."""
    k = F.col("id")
    cols = [((k * 37) % 23 / 3.0), ((k * 11) % 17 + (k % 5) / 2.0), F.when(k % 2 == 0, "a").otherwise("b"), F.concat(F.lit("l"), k % 3), F.concat(F.lit("s"), k % 2)]
    return spark.range(90).select(k.alias("_row_id"), *[c.alias(n) for c, n in zip(cols, names)])


OPERATORS = {
    "t_test": lambda d, x, y, g, h, s: comparisons.t_test(d, x, g, [s]),
    "anova": lambda d, x, y, g, h, s: comparisons.anova(d, x, h, [s]),
    "pairwise": lambda d, x, y, g, h, s: comparisons.pairwise_t(d, x, h, [s]),
    "levene": lambda d, x, y, g, h, s: comparisons.levene(d, x, h, [s]),
    "mann_whitney": lambda d, x, y, g, h, s: comparisons.mann_whitney(d, x, h, [s]),
    "kruskal": lambda d, x, y, g, h, s: comparisons.kruskal(d, x, h, [s]),
    "reliability": lambda d, x, y, g, h, s: comparisons.reliability(d, [x, y], [s]),
    "item_totals": lambda d, x, y, g, h, s: comparisons.item_totals(d, [x, y], [s]),
    "chi_square": lambda d, x, y, g, h, s: crosstab.chi_square(d, g, h, [s]),
    "residuals": lambda d, x, y, g, h, s: crosstab.residuals(d, g, h, [s]),
    "margins": lambda d, x, y, g, h, s: crosstab.with_margins(d, g, h),
    "spearman": lambda d, x, y, g, h, s: correlation.spearman(d, [x, y], [s]),
    "pearson": lambda d, x, y, g, h, s: correlation.pearson(d, [x, y]),
    "quantiles": lambda d, x, y, g, h, s: ranks.quantiles(d, [x, y], [0.3], [s]),
    "quantiles_whole": lambda d, x, y, g, h, s: ranks.quantiles(d, [x, y], [0.3]),
    "describe": lambda d, x, y, g, h, s: summaries.describe(d, [x, y], [s], normality=True),
    "frequencies": lambda d, x, y, g, h, s: summaries.frequencies(d, [g, h]),
    "medians": lambda d, x, y, g, h, s: summaries.group_medians(d, x, h, [s]),
    "fences": lambda d, x, y, g, h, s: outliers.fences(d, [x, y], by=[s]),
    "outliers": lambda d, x, y, g, h, s: outliers.outlier_rows(d, [x, y], "_row_id", factor=0.1),
    "impute": lambda d, x, y, g, h, s: outliers.impute(d, [x], [g]).select(F.sum(col(x)).alias("sum")),
    "shapiro": lambda d, x, y, g, h, s: normality.shapiro_table(d, [x, y], [s]),
    "coefficients": lambda d, x, y, g, h, s: regression.coef_table(d, y, [x], [s]),
    "model": lambda d, x, y, g, h, s: regression.model_summary(d, y, [x], [s]).drop("equation"),
    "residual_rows": lambda d, x, y, g, h, s: regression.residual_rows(d, y, [x], ["_row_id"]).select(F.sum(F.abs("residual")).alias("r")),
    "histogram": lambda d, x, y, g, h, s: chartdata.histogram(d, x),
    "box_plot": lambda d, x, y, g, h, s: chartdata.box_plot(d, x, h),
    "density": lambda d, x, y, g, h, s: chartdata.density(d, x, grid=5),
    "value_counts": lambda d, x, y, g, h, s: profile.value_counts(d, [x, g], "_row_id").groupBy("variable").agg(F.count("*").alias("c")),
    "duplicates": lambda d, x, y, g, h, s: dedup.flag_duplicates(d, [g, h], "_row_id").groupBy("_duplicate_flag").count(),
    "unique": lambda d, x, y, g, h, s: dedup.drop_duplicates(d, [g, h], "_row_id").select("_row_id"),
}


def figures(df, names, plain):
    """Rows without the columns' names: those are translated back to the plain ones."""
    back = dict(zip(names, plain)) | {f"{n}_by": p for n, p in zip(names, plain)}
    out = []
    for r in df.collect():
        # columns by place: an own column may be called like a figure
        out.append(tuple(repr(round(v, 9)) if isinstance(v, float) else repr(back.get(v, v) if isinstance(v, str) else v) for v in r))
    return sorted(out)


PLAIN = ["x_", "y_", "g_", "h_", "s_"]


@pytest.fixture(scope="module")
def expected(spark):
    return {k: figures(fn(table(spark, PLAIN), *PLAIN), PLAIN, PLAIN) for k, fn in OPERATORS.items()}


@pytest.mark.parametrize("name, shift", [(n, 0) for n in sorted(OPERATORS)] + [(n, 5) for n in ("quantiles", "describe", "mann_whitney", "chi_square", "spearman", "duplicates")])
def test_any_name(spark, expected, name, shift):
    names = [NAMES[(shift + i) % len(NAMES)] for i in range(5)]
    got = OPERATORS[name](table(spark, names), *names)
    assert figures(got, names, PLAIN) == expected[name]


def test_digest_column_is_kept(spark):
    df = spark.range(6).select(F.col("id").alias("_row_id"), (F.col("id") % 3).cast("string").alias("_digest"), F.lit("x").alias("_copies"))
    got = dedup.flag_duplicates(df, ["_digest"], "_row_id")
    assert sorted(r["_digest"] for r in got.collect()) == ["0", "0", "1", "1", "2", "2"]


def test_clean_any_names(spark):
    df = spark.range(40).select(F.col("id").alias("_row_id"), (F.col("id") % 9).cast("string").alias("price.usd"), F.concat(F.lit("t"), F.col("id")).alias("a`b"),
                                F.lit("x").alias("n"), F.lit("y").alias("  "), (F.col("id") * 3 % 50).cast("string").alias("price usd"))
    r = cleaning.clean(df, rename=False)
    assert r.data.columns == ["_row_id", "priceusd", "ab", "n", "col_4", "price_usd"]
    assert r.stats["rows_out"] == 40 and r.types["price_usd"] == "numeric"


def test_clean_without_rows(spark):
    df = spark.createDataFrame([], "_row_id long, `a b` string, n string")
    for exact in (True, False):
        r = cleaning.clean(df, exact=exact)
        assert r.data.columns == ["_row_id", "a_b", "n"] or r.data.columns[1:2] == ["a_b"]
        assert (r.stats["rows_in"], r.stats["rows_out"], set(r.types.values())) == (0, 0, {"empty"})
        assert r.tables["cleaned_data"].count() == 0 and r.log[-1][1] == "Data quality scored"


def test_not_a_number(spark):
    df = spark.range(5).select(F.lit(float("nan")).alias("x"), F.when(F.col("id") > 1, F.col("id").cast("double")).otherwise(F.lit(float("nan"))).alias("y"))
    got = {r["variable"]: r["q"] for r in ranks.quantiles(df, ["x", "y"], [0.5]).collect()}
    assert got == {"x": None, "y": [3.0]}
