"""Numeric descriptives, frequencies and group summaries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.parsing import to_number
from statloom.functions.scalars import r4, skew_label
from statloom.operators.naming import col, plain_names
from statloom.operators.normality import jarque_bera, shapiro_table
from statloom.operators.ranks import quantiles
from statloom.operators.skew import null_safe_join

_MARKERS = ["", "N/A", "nan"]


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns read as doubles (text that is no number, and NaN, become null); others kept."""
    types = dict(df.dtypes)
    return df.withColumns({c: to_number(col(c), types[c]) for c in columns})


def missing_cell(c: str, dtype: str) -> Column:
    if dtype == "string":
        return col(c).isNull() | F.trim(col(c)).isin(_MARKERS)
    if dtype in ("double", "float"):
        return col(c).isNull() | F.isnan(col(c))
    return col(c).isNull()


def split_numeric(df: DataFrame, columns: list[str], share: float = 0.5) -> tuple[list[str], list[str]]:
    """Columns whose numeric reading covers more than `share` of the rows, and the others; one aggregate job."""
    types = dict(df.dtypes)
    plain = [c for c in columns if types[c] == "string"]
    if not plain:
        keep = [c for c in columns if types[c] not in ("boolean", "date") and not types[c].startswith("timestamp")]
        return keep, [c for c in columns if c not in keep]
    row = numeric(df, columns).agg(F.count("*").alias("_rows"),
                                   *[F.count(col(c)).alias(f"n_{i}") for i, c in enumerate(columns)]).first()
    keep = [c for i, c in enumerate(columns) if row[f"n_{i}"] > share * row["_rows"]]
    return keep, [c for c in columns if c not in keep]


def sample_skew(c: str) -> Column:
    """Bias-corrected skewness, null below three values."""
    n = F.count(c)
    return F.when(n >= 3, F.coalesce(F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2.0), F.lit(0.0)))


def sample_kurtosis(c: str) -> Column:
    """Bias-corrected excess kurtosis, null below four values."""
    n = F.count(c)
    fixed = (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * F.kurtosis(c) + 6.0)
    return F.when(n >= 4, F.coalesce(fixed, F.lit(0.0)))


@plain_names("columns", "by", told=("variable",))
def describe(df: DataFrame, columns: list[str], by: list[str] = (), normality: bool = False) -> DataFrame:
    """One row per (segment, numeric column): N, missing, moments, quartiles; with `normality` also the Jarque-Bera
    and the Shapiro-Wilk p of the whole column."""
    by = list(by)
    types = dict(df.dtypes)
    flags = {f"_missing_{i}": missing_cell(c, types[c]) for i, c in enumerate(columns)}
    num = numeric(df.withColumns(flags), columns)
    aggs = []
    for i, c in enumerate(columns):
        aggs.append(F.struct(
            F.lit(c).alias("variable"), F.count(c).alias("n"), F.count_if(f"_missing_{i}").alias("missing"),
            F.avg(c).alias("mean"), F.stddev_samp(c).alias("std_dev"), F.min(c).alias("min"), F.max(c).alias("max"),
            sample_skew(c).alias("skewness"), sample_kurtosis(c).alias("kurtosis")))
    # the moments stay apart from the quantiles: together they would leave the generated-code aggregate
    moments = num.groupBy(*by).agg(F.array(*aggs).alias("_r")).select(*by, F.inline("_r")).where("n > 0")
    out = null_safe_join(moments, quantiles(num, columns, [0.5, 0.25, 0.75], by), [*by, "variable"])
    cols = [*by, "variable", "n", "missing", r4("mean").alias("mean"), r4(F.get("q", F.lit(0))).alias("median"),
            r4("std_dev").alias("std_dev"), r4("min").alias("min"), r4("max").alias("max"),
            r4(F.get("q", F.lit(1))).alias("q1"), r4(F.get("q", F.lit(2))).alias("q3"),
            r4("skewness").alias("skewness"), r4("kurtosis").alias("kurtosis")]
    if not normality:
        return out.select(*cols)
    whole = jarque_bera(num, columns, by).select(*by, "variable", r4("p").alias("normality_p"))
    tests = shapiro_table(num, columns, by).select(*by, "variable", r4("p").alias("shapiro_p"))
    out = null_safe_join(null_safe_join(out, whole, [*by, "variable"], "left"), tests, [*by, "variable"], "left")
    return out.select(*cols, "normality_p", "shapiro_p")


def skew_notes(described: DataFrame) -> DataFrame:
    """Shape label and sentence per variable."""
    label = skew_label(F.col("skewness"))
    text = F.format_string("N=%d, M=%.2f, SD=%.2f. Distribution is %s.", "n", "mean", "std_dev", label)
    return described.select("variable", label.alias("shape"), text.alias("note"))


@plain_names("columns", told=("variable",))
def frequencies(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and percentages of every category, most frequent first within a variable."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot(
        [], columns, "variable", "category").where("category IS NOT NULL")
    counts = long.groupBy("variable", "category").agg(F.count("*").alias("n"))
    totals = counts.groupBy("variable").agg(F.sum("n").alias("_total"))  # one row per named column
    share = F.round(F.col("n") * 100.0 / F.col("_total"), 2)
    return counts.join(F.broadcast(totals), "variable").select(
        "variable", "category", "n", share.alias("percent")).orderBy("variable", F.desc("n"), "category")


@plain_names("value", "group", "by")
def group_summary(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    """N, mean, variance, SD, standard error and range per group; the base of every mean comparison."""
    return (numeric(df, [value]).where(F.col(value).isNotNull() & F.col(group).isNotNull())
            .groupBy(*by, F.col(group).alias("grp"))
            .agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"),
                 F.min(value).alias("min"), F.max(value).alias("max"))
            .withColumn("std_dev", F.sqrt("var")).withColumn("std_error", F.sqrt(F.col("var") / F.col("n"))))


@plain_names("value", "group", "by")
def group_medians(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    num = numeric(df, [value]).where(F.col(value).isNotNull() & F.col(group).isNotNull())
    q = quantiles(num, [value], [0.5], [*by, group])
    return q.select(*by, F.col(group).alias("grp"), F.get("q", F.lit(0)).alias("median"))
