"""Registered queries: the data behind figures."""

from pyspark.sql import functions as F

from statloom.catalog import sqltools as q
from statloom.catalog.statistics import rounded
from statloom.catalog.views import table
from statloom.functions import scalars as sc
from statloom.functions.tails import normal_upper
from statloom.operators import chartdata

QUERIES: dict = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


_BINS = """WITH s AS (SELECT count(*) AS n, min({x}) AS lo, max({x}) AS hi, avg({x}) AS m, quantile_cont({x}, 0.5) AS md,
  quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) AS iqr FROM {t}),
w AS (SELECT *, CASE WHEN iqr > 0 THEN least((hi - lo) / (log2(n) + 1), 2 * iqr / pow(n, 1 / 3.0)) ELSE (hi - lo) / (log2(n) + 1) END
  AS width FROM s),
b AS (SELECT *, CAST(ceil((hi - lo) / width) AS INTEGER) AS bins FROM w),
h AS (SELECT least(CAST(floor(({x} - lo) / ((hi - lo) / bins)) AS INTEGER), bins - 1) AS bin, count(*) AS n FROM {t}, b GROUP BY 1)
SELECT CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) / bins * i, 4) AS bin_low, round(lo + (hi - lo) / bins * (i + 1), 4) AS bin_high,
  coalesce(h.n, 0) AS n, round(m, 4) AS mean, round(md, 4) AS median
FROM b, range(0, (SELECT bins FROM b)) AS g(i) LEFT JOIN h ON h.bin = i"""


@register("histogram_price", _BINS.format(x="o_totalprice", t="orders"))
def histogram(spark, d):
    return rounded(chartdata.histogram(table(spark, d, "orders"), "o_totalprice"), "bin_low", "bin_high", "mean", "median")


@register("histogram_event_value", _BINS.format(x="value", t="events"))
def histogram_skewed(spark, d):
    return rounded(chartdata.histogram(table(spark, d, "events"), "value"), "bin_low", "bin_high", "mean", "median")


_BOX = """WITH q AS (SELECT {g} AS grp, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS md, quantile_cont({x}, 0.75) AS q3
  FROM {t} GROUP BY 1)"""


@register("boxplot_by_segment", _BOX.format(g="c_mktsegment", x="c_acctbal", t="customer") + """
SELECT grp, round(q1, 4) AS q1, round(md, 4) AS median, round(q3, 4) AS q3,
  min(c_acctbal) FILTER (c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(c_acctbal) FILTER (c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (NOT c_acctbal BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS fliers
FROM customer JOIN q ON c_mktsegment = grp GROUP BY grp, q1, md, q3""")
def box_plot(spark, d):
    return rounded(chartdata.box_plot(table(spark, d, "customer"), "c_acctbal", "c_mktsegment"), "q1", "median", "q3")


@register("box_fliers_events", _BOX.format(g="event_type", x="value", t="events") + """
SELECT event_id, grp, value FROM events JOIN q ON event_type = grp
WHERE NOT value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def box_fliers(spark, d):
    return chartdata.box_fliers(table(spark, d, "events"), "value", "event_type", ["event_id"])


@register("category_shares", """SELECT event_type AS category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 4) AS percent
FROM events GROUP BY 1""")
def category_shares(spark, d):
    return chartdata.shares(table(spark, d, "events"), "event_type")


@register("stacked_percents_status", """SELECT o_orderpriority AS v1, o_orderstatus AS v2, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY o_orderpriority), 4) AS percent FROM orders GROUP BY 1, 2""")
def stacked(spark, d):
    return rounded(chartdata.stacked_percents(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus"), "percent")


@register("density_acctbal", """WITH s AS (SELECT c_mktsegment AS grp, count(*) AS n, min(c_acctbal) AS lo, max(c_acctbal) AS hi,
  stddev_samp(c_acctbal) AS sd FROM customer GROUP BY 1),
c AS (SELECT grp, n, lo, hi, sd, least(floor((c_acctbal - lo) / ((hi - lo) / 512.0)), 511) AS cell, count(*) AS c, avg(c_acctbal) AS x
  FROM customer JOIN s ON c_mktsegment = grp GROUP BY ALL),
p AS (SELECT *, sd * pow(n, -0.2) AS h, lo + (hi - lo) * i / 99.0 AS gx FROM c, range(0, 100) AS g(i))
SELECT grp AS c_mktsegment, round(gx, 4) AS x, round(1000 * sum(c * exp(-pow((gx - p.x) / h, 2) / 2) / (n * h * sqrt(2 * pi()))), 6) AS density
FROM p GROUP BY grp, i, gx""")
def density(spark, d):
    out = chartdata.density(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return out.select("c_mktsegment", sc.r4("x").alias("x"), F.round(F.col("density") * 1000, 6).alias("density"))


_LINE = """s AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity)
  AS a, var_samp(l_quantity) * (count(*) - 1) AS sxx, var_samp(l_extendedprice) * (count(*) - 1) AS syy,
  covar_samp(l_quantity, l_extendedprice) * (count(*) - 1) AS sxy, avg(l_quantity) AS mx, min(l_quantity) AS lo,
  max(l_quantity) AS hi FROM lineitem),
m AS (SELECT *, sqrt((syy - b * sxy) / (n - 2) / sxx) AS se FROM s)"""


@register("regression_band", f"""WITH {_LINE},
p AS (SELECT *, lo + (hi - lo) * i / 199.0 AS x FROM m, range(0, 200) AS g(i)),
h AS (SELECT *, {q.t_quantile_975('n - 2')} * se * sqrt(1.0 / n + pow(x - mx, 2) / sxx) AS h FROM p)
SELECT CAST(i AS INTEGER) AS i, round(x, 4) AS x, round(a + b * x, 4) AS fitted, round(a + b * x - h, 4) AS low,
  round(a + b * x + h, 4) AS high FROM h""")
def regression_band(spark, d):
    out = chartdata.regression_band(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return rounded(out, "x", "fitted", "low", "high")


@register("coefficient_intervals", f"""WITH {_LINE} SELECT 'l_quantity' AS predictor, round(b, 4) AS b, round(b - 1.96 * se, 4) AS low,
  round(b + 1.96 * se, 4) AS high FROM m""")
def coefficient_intervals(spark, d):
    return chartdata.coefficient_intervals(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])


_QQ = """r AS (SELECT row_number() OVER (ORDER BY o_totalprice) AS position, o_totalprice AS observed, count(*) OVER () AS n FROM orders),
t AS (SELECT position, observed, CASE WHEN position = n THEN pow(0.5, 1.0 / n) WHEN position = 1 THEN 1 - pow(0.5, 1.0 / n)
  ELSE (position - 0.3175) / (n + 0.365) END AS p FROM r)"""


@register("qq_points")
def qq_points(spark, d):
    return rounded(chartdata.qq_points(table(spark, d, "orders"), "o_totalprice"), "theoretical")


@register("qq_positions", f"WITH {_QQ} SELECT position, observed, round(p, 8) AS probability FROM t")
def qq_positions(spark, d):
    out = chartdata.qq_points(table(spark, d, "orders"), "o_totalprice")
    return out.select("position", "observed", F.round(1 - normal_upper("theoretical"), 8).alias("probability"))


@register("qq_line")
def qq_line(spark, d):
    return rounded(chartdata.qq_line(chartdata.qq_points(table(spark, d, "orders"), "o_totalprice")), "slope", "intercept", "r")


@register("scatter_points", """WITH e AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem),
c AS (SELECT CAST(least(floor((l_quantity - x0) / ((x1 - x0) / 100)), 99) AS INTEGER) AS x_cell,
  CAST(least(floor((l_extendedprice - y0) / ((y1 - y0) / 100)), 99) AS INTEGER) AS y_cell, l_quantity, l_extendedprice FROM lineitem, e)
SELECT x_cell, y_cell, count(*) AS n, round(sum(l_quantity), 2) AS x_sum, round(sum(l_extendedprice), 2) AS y_sum FROM c GROUP BY 1, 2""")
def scatter(spark, d):
    cells = chartdata.scatter_cells(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return cells.select("x_cell", "y_cell", "n", F.round(F.col("x") * F.col("n"), 2).alias("x_sum"), F.round(F.col("y") * F.col("n"), 2).alias("y_sum"))
