"""The numbers behind each figure: bins, boxes, quantile points, bands, densities, counted points."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalars import r4
from statloom.functions.tails import normal_quantile, t_quantile
from statloom.operators import crosstab, regression
from statloom.operators.naming import plain_names
from statloom.operators.ranks import cumulative, quantiles, value_table
from statloom.operators.skew import lookup_by_key
from statloom.operators.summaries import group_summary, numeric
from statloom.session import settle


# Bins listed by one row.
RUN = 4096


def _stats(num: DataFrame, value: str) -> DataFrame:
    q = quantiles(num, [value], [0.25, 0.5, 0.75]).select("q")
    base = num.agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"),
                   F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    return base.withColumn("q", q.scalar())


@plain_names("value")
def histogram(df: DataFrame, value: str) -> DataFrame:
    """Automatic bins: the narrower of the Sturges and Freedman-Diaconis widths; empty bins are kept."""
    num = numeric(df, [value]).where(F.col(value).isNotNull())
    span = F.col("high") - F.col("low")
    iqr = F.get("q", F.lit(2)) - F.get("q", F.lit(0))
    sturges = span / (F.log2(F.col("n").cast("double")) + 1)
    fd = 2 * iqr / F.pow(F.col("n"), F.lit(1 / 3))
    width = F.when(fd > 0, F.least(sturges, fd)).otherwise(sturges)
    bins = F.when(span > 0, F.ceil(F.try_divide(span, width)).cast("long")).otherwise(F.lit(1).cast("long"))
    plan = settle(_stats(num, value).select("low", "high", "mean", F.get("q", F.lit(1)).alias("median"), bins.alias("bins")))
    packed = plan.select(F.struct("*").alias("s")).scalar()
    step = (packed["high"] - packed["low"]) / packed["bins"]
    at = F.when(step > 0, F.least(F.floor((F.col(value) - packed["low"]) / step).cast("long"), packed["bins"] - 1)
                ).otherwise(0)
    held = num.select(at.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    # bins are listed in runs, spread over tasks: one far value may ask for very many
    runs = plan.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bins") - 1, F.lit(RUN).cast("long"))).alias("_run"))
    runs = runs.repartition("_run")
    edges = runs.select("*", F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + RUN, F.col("bins")) - 1)).alias("bin"))
    size = (F.col("high") - F.col("low")) / F.col("bins")
    return edges.join(held, "bin", "left").select(
        F.col("bin").cast("int").alias("bin"), (F.col("low") + size * F.col("bin")).alias("bin_low"),
        (F.col("low") + size * (F.col("bin") + 1)).alias("bin_high"), F.coalesce("n", F.lit(0)).alias("n"),
        "mean", "median")


@plain_names("value", "group")
def box_plot(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles, whiskers at the furthest points inside 1.5 IQR, and the count of points beyond them."""
    num = numeric(df, [value]).where(F.col(value).isNotNull() & F.col(group).isNotNull())
    q = quantiles(num, [value], [0.25, 0.5, 0.75], [group]).select(
        group, F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("median"),
        F.get("q", F.lit(2)).alias("q3"))
    rows = lookup_by_key(num, q, [group])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    return rows.groupBy(F.col(group).alias("grp"), "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"), F.count_if(~inside).alias("fliers"))


@plain_names("value", "group", "row_id")
def box_fliers(df: DataFrame, value: str, group: str, row_id: list[str]) -> DataFrame:
    """The points beyond the whiskers."""
    num = numeric(df, [value]).where(F.col(value).isNotNull() & F.col(group).isNotNull())
    q = quantiles(num, [value], [0.25, 0.75], [group]).select(group, "q")
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    reach = 1.5 * (q3 - q1)
    return (lookup_by_key(num, q, [group]).where(~F.col(value).between(q1 - reach, q3 + reach))
            .select(*row_id, F.col(group).alias("grp"), F.col(value).alias("value")))


@plain_names("value")
def qq_points(df: DataFrame, value: str) -> DataFrame:
    """Normal quantile plot: order-statistic medians against values, one point per row.

    Positions are read from the cumulative counts and listed in runs, so a value that fills a third of the table is
    spread over tasks.
    """
    num = numeric(df, [value]).where(F.col(value).isNotNull())
    size = num.agg(F.count("*").alias("n")).scalar()
    cum = cumulative(value_table(num, value), value)
    end = F.col("below") + F.col("tie")
    runs = cum.select(value, end.alias("_end"), F.explode(F.sequence(F.col("below"), end - 1, F.lit(RUN).cast("long"))).alias("_run"))
    spread = runs.repartition("_run").select(value, F.explode(F.sequence(F.col("_run"), F.least(F.col("_run") + RUN, F.col("_end")) - 1)).alias("at"),
                                             size.alias("n"))
    i = F.col("at") + 1
    n = F.col("n").cast("double")
    edge = F.pow(F.lit(0.5), 1 / n)
    median = F.when(i == n, edge).when(i == 1, 1 - edge).otherwise((i - 0.3175) / (n + 0.365))
    return spread.select(i.alias("position"), normal_quantile(median).alias("theoretical"),
                         F.col(value).alias("observed"))


def qq_line(points: DataFrame) -> DataFrame:
    return points.agg(F.regr_slope("observed", "theoretical").alias("slope"),
                      F.regr_intercept("observed", "theoretical").alias("intercept"),
                      F.corr("observed", "theoretical").alias("r"))


@plain_names("column")
def shares(df: DataFrame, column: str) -> DataFrame:
    """Bar heights and pie shares."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("category")).agg(
        F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("category", "n", r4(F.col("n") * 100.0 / total).alias("percent"))


def stacked_percents(df: DataFrame, var1: str, var2: str) -> DataFrame:
    return crosstab.row_percents(df, var1, var2)


def mean_intervals(df: DataFrame, value: str, group: str) -> DataFrame:
    half = 1.96 * F.col("std_error")
    return group_summary(df, value, group).select("grp", "n", "mean", (F.col("mean") - half).alias("low"),
                                                  (F.col("mean") + half).alias("high"))


@plain_names("value", "group")
def density(df: DataFrame, value: str, group: str | None = None, cells: int = 512, grid: int = 100) -> DataFrame:
    """Gaussian density on an even grid, Scott bandwidth, from binned counts.

    Rows are reduced to at most `cells` counted bins per group first, so only counts meet the grid.
    """
    by = [] if group is None else [group]
    num = numeric(df, [value]).where(F.col(value).isNotNull()).select(*by, value)
    stats = num.groupBy(*by).agg(F.count("*").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"),
                                 F.stddev_samp(value).alias("_sd"))
    if by:
        rows = lookup_by_key(num.where(F.col(group).isNotNull()), stats.where(F.col(group).isNotNull()), by)
    else:
        rows = num.withColumns({c: stats.select(c).scalar() for c in ("_n", "_low", "_high", "_sd")})
    width = (F.col("_high") - F.col("_low")) / cells
    cell = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_low")) / width), F.lit(cells - 1))).otherwise(0)
    held = rows.groupBy(*by, "_n", "_low", "_high", "_sd", cell.alias("_cell")).agg(
        F.count("*").alias("_c"), F.avg(value).alias("_x"))
    band = F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))
    span = F.col("_high") - F.col("_low")
    at = held.where(band > 0).select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("_i")).withColumn(
        "x", F.col("_low") + span * F.col("_i") / (grid - 1))
    z = (F.col("x") - F.col("_x")) / band
    weight = F.col("_c") * F.exp(-z * z / 2) / (F.col("_n") * band * math.sqrt(2 * math.pi))
    return at.groupBy(*by, "_i").agg(F.first("x").alias("x"), F.sum(weight).alias("density")).drop("_i")


@plain_names("x", "y")
def scatter_cells(df: DataFrame, x: str, y: str, cells: int = 100) -> DataFrame:
    """Scatter plot of every complete row: an even grid of `cells` by `cells`, with the rows and mean point of each filled cell."""
    rows = numeric(df, [x, y]).dropna(subset=[x, y])
    ends = rows.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1")).alias("e")).scalar()

    def cell(c, low, high):
        step = (ends[high] - ends[low]) / cells
        return F.when(step > 0, F.least(F.floor((F.col(c) - ends[low]) / step), F.lit(cells - 1))).otherwise(0).cast("int")

    return rows.groupBy(cell(x, "x0", "x1").alias("x_cell"), cell(y, "y0", "y1").alias("y_cell")).agg(
        F.count("*").alias("n"), F.avg(x).alias("x"), F.avg(y).alias("y"))


@plain_names("dependent", "predictor")
def regression_band(df: DataFrame, dependent: str, predictor: str, points: int = 200) -> DataFrame:
    """Line and 95 % band on an even grid over the predictor's range."""
    rows = regression.complete_rows(df, dependent, [predictor])
    fit = regression.coefficients(rows, dependent, [predictor])
    one = fit.groupBy().agg(
        F.max(F.when(F.col("position") == 0, F.col("b"))).alias("intercept"),
        F.max(F.when(F.col("position") == 1, F.col("b"))).alias("slope"),
        F.max(F.when(F.col("position") == 1, F.col("std_error"))).alias("se"),
        F.max("mean_x").alias("mean_x"), F.max("sxx").alias("sxx"), F.max("n").alias("n"))
    ends = rows.agg(F.struct(F.min(predictor).alias("low"), F.max(predictor).alias("high")).alias("e")).scalar()
    grid = one.withColumn("_e", ends).select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
    x = F.col("_e.low") + (F.col("_e.high") - F.col("_e.low")) * F.col("i") / (points - 1)
    mid = F.col("intercept") + F.col("slope") * F.col("x")
    gap = F.col("x") - F.col("mean_x")
    half = F.col("_t") * F.col("se") * F.sqrt(1 / F.col("n") + gap * gap / F.col("sxx"))
    return (grid.withColumn("x", x).withColumn("_t", t_quantile(F.lit(0.975), (F.col("n") - 2).cast("double")))
            .select("i", "x", mid.alias("fitted"), (mid - half).alias("low"), (mid + half).alias("high")))


def coefficient_intervals(df: DataFrame, dependent: str, predictors: list[str]) -> DataFrame:
    c = regression.coefficients(df, dependent, predictors).where("position > 0")
    half = 1.96 * F.col("std_error")
    return c.select("predictor", r4("b").alias("b"), r4(F.col("b") - half).alias("low"),
                    r4(F.col("b") + half).alias("high"))
