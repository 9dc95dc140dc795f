"""Registered queries: statistics, tests, regressions."""

from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.catalog import sqltools as q
from statloom.catalog.views import table
from statloom.functions import scalars as sc
from statloom.operators import (assumptions, comparisons, correlation, crosstab, normality, outliers, ranks, regression,
                                summaries)
from statloom.plans import interpret, study
from statloom.session import literal_rows

LINE_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = ["l_orderkey", "l_linenumber"]
QUERIES: dict = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


def rounded(df, *names):
    return df.withColumns({n: sc.r4(n) for n in names})


# --- group comparisons ----------------------------------------------------------

_PRICE_GROUPS = """g AS (SELECT o_orderpriority AS grp, count(*) AS n, avg(o_totalprice) AS m, var_samp(o_totalprice) AS v,
  min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1)"""
_ANOVA = f"""{_PRICE_GROUPS},
a AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS ssw FROM g),
f AS (SELECT k, n, ssb, ssw, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM a,
  (SELECT sum(g.n * pow(g.m - a.gm, 2)) AS ssb FROM g, a))"""


@register("anova_price_by_priority", f"""WITH {_ANOVA}
SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, CAST(k - 1 AS BIGINT) AS df_between,
  CAST(n - k AS BIGINT) AS df_within, round(f, 4) AS f_statistic, round(ssb / (ssb + ssw), 6) AS eta_squared,
  CASE WHEN ssb / (ssb + ssw) < 0.06 THEN 'small' WHEN ssb / (ssb + ssw) < 0.14 THEN 'medium' ELSE 'large' END
  AS effect_size, round(p, 4) AS p_value, {q.stars('p')} AS significance
FROM (SELECT *, {q.f_upper('f', 'k - 1', 'n - k')} AS p FROM f)""")
def anova_price(spark, d):
    out = comparisons.anova(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return out.select("k", "n", "df_between", "df_within", sc.r4("f_statistic").alias("f_statistic"),
                      F.round("eta_squared", 6).alias("eta_squared"), "effect_size",
                      sc.r4("p_value").alias("p_value"), "significance")


@register("group_summary_priority", f"""WITH {_PRICE_GROUPS}
SELECT grp, n, round(m, 4) AS mean, round(sqrt(v), 4) AS std_dev, round(sqrt(v / n), 4) AS std_error, lo AS min, hi AS max
FROM g""")
def group_summary(spark, d):
    out = summaries.group_summary(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return rounded(out, "mean", "std_dev", "std_error").drop("var")


_POST = f"""WITH {_PRICE_GROUPS},
p AS (SELECT a.grp AS group_1, b.grp AS group_2, a.m - b.m AS md, a.n + b.n - 2 AS df,
  (a.m - b.m) / sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) * (1.0 / a.n + 1.0 / b.n)) AS t
  FROM g a JOIN g b ON a.grp < b.grp),
r AS (SELECT *, least(1.0, {q.t_two_sided('t', 'df')} * (SELECT count(*) FROM p)) AS pb FROM p)
SELECT group_1, group_2, round(md, 4) AS mean_diff, round(t, 4) AS t, round(pb, 4) AS p_bonferroni,
  CASE WHEN pb < 0.05 THEN 'Yes' ELSE 'No' END AS significant FROM r"""


@register("anova_posthoc_priority", _POST)
def posthoc(spark, d):
    out = comparisons.pairwise_t(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return rounded(out, "mean_diff", "t", "p_bonferroni").drop("pairs", "df")


@register("mean_intervals_priority", f"""WITH {_PRICE_GROUPS}
SELECT grp, n, round(m, 4) AS mean, round(m - 1.96 * sqrt(v / n), 4) AS low, round(m + 1.96 * sqrt(v / n), 4) AS high FROM g""")
def mean_intervals(spark, d):
    from statloom.operators.chartdata import mean_intervals as intervals
    return rounded(intervals(table(spark, d, "orders"), "o_totalprice", "o_orderpriority"), "mean", "low", "high")


def _ttest_sql(by: str) -> str:
    key = f"{by} AS {by}, " if by else ""
    grp = f"{by}, " if by else ""
    on = f"a.{by} = b.{by} AND " if by else ""
    head = f"a.{by} AS {by}, " if by else ""
    return f"""WITH g AS (SELECT {key}l_linestatus AS grp, count(*) AS n, avg(l_quantity) AS m, var_samp(l_quantity) AS v
  FROM lineitem GROUP BY {grp}l_linestatus),
t AS (SELECT {head}a.grp AS group_1, b.grp AS group_2, a.n AS n_1, b.n AS n_2, a.m AS m1, b.m AS m2, a.m - b.m AS md,
  sqrt(((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) AS sp, a.v / a.n AS s1, b.v / b.n AS s2, a.v AS v1, b.v AS v2
  FROM g a JOIN g b ON {on}a.grp < b.grp),
u AS (SELECT *, md / (sp * sqrt(1.0 / n_1 + 1.0 / n_2)) AS tp, md / sqrt(s1 + s2) AS tw, n_1 + n_2 - 2 AS dfp,
  pow(s1 + s2, 2) / (s1 * s1 / (n_1 - 1) + s2 * s2 / (n_2 - 1)) AS dfw FROM t)
SELECT {grp}group_1, group_2, n_1, n_2, round(m1, 4) AS mean_1, round(m2, 4) AS mean_2, round(md, 4) AS mean_difference,
  round(tp, 4) AS t_pooled, round({q.t_two_sided('tp', 'dfp')}, 4) AS p_pooled, round(tw, 4) AS t_welch,
  round(dfw, 2) AS df_welch, round({q.t_two_sided('tw', 'dfw')}, 4) AS p_welch, round(md / sp, 4) AS cohens_d,
  CASE WHEN abs(md / sp) < 0.2 THEN 'negligible' WHEN abs(md / sp) < 0.5 THEN 'small' WHEN abs(md / sp) < 0.8
  THEN 'medium' ELSE 'large' END AS effect_size,
  round(md - {q.t_quantile_975('dfw')} * sqrt(s1 + s2), 4) AS ci_low,
  round(md + {q.t_quantile_975('dfw')} * sqrt(s1 + s2), 4) AS ci_high FROM u"""


def _ttest(df, by=()):
    out = comparisons.t_test(df, "l_quantity", "l_linestatus", list(by))
    out = rounded(out, "mean_1", "mean_2", "mean_difference", "t_pooled", "p_pooled", "t_welch", "p_welch", "cohens_d",
                  "ci_low", "ci_high").withColumn("df_welch", F.round("df_welch", 2))
    return out.select(*by, "group_1", "group_2", "n_1", "n_2", "mean_1", "mean_2", "mean_difference", "t_pooled",
                      "p_pooled", "t_welch", "df_welch", "p_welch", "cohens_d", "effect_size", "ci_low", "ci_high")


@register("ttest_qty_by_linestatus", _ttest_sql(""))
def ttest(spark, d):
    return _ttest(table(spark, d, "lineitem"))


@register("ttest_by_segment", _ttest_sql("l_returnflag"))
def ttest_by(spark, d):
    return _ttest(table(spark, d, "lineitem"), ["l_returnflag"])


_MW = f"""WITH c AS (SELECT l_quantity AS v, l_linestatus AS grp, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS {q.average_ranks('lineitem', 'l_quantity')},
s AS (SELECT grp, sum(c.n) AS n, sum(c.n * r.r) AS rs FROM c JOIN r USING (v) GROUP BY 1),
w AS (SELECT a.grp AS group_1, b.grp AS group_2, CAST(a.n AS BIGINT) AS n_1, CAST(b.n AS BIGINT) AS n_2,
  a.rs - a.n * (a.n + 1) / 2.0 AS u, 1.0 * a.n * b.n AS nn, 1.0 * (a.n + b.n) AS nt,
  (SELECT sum(1.0 * n * n * n - n) FROM r) AS ties FROM s a JOIN s b ON a.grp < b.grp),
z AS (SELECT *, (greatest(u, nn - u) - nn / 2 - 0.5) / sqrt(nn / 12 * (nt + 1 - ties / (nt * (nt - 1)))) AS z FROM w),
m AS (SELECT l_linestatus AS grp, quantile_cont(l_quantity, 0.5) AS med FROM lineitem GROUP BY 1)
SELECT group_1, group_2, n_1, n_2, (SELECT med FROM m WHERE grp = group_1) AS median_1,
  (SELECT med FROM m WHERE grp = group_2) AS median_2, round(u, 2) AS u_statistic,
  round(least(1.0, {q.normal_two_sided('z')}), 4) AS p_value, round(z / sqrt(nt), 4) AS effect_r FROM z"""


@register("mannwhitney_qty_by_linestatus", _MW)
def mann_whitney(spark, d):
    out = comparisons.mann_whitney(table(spark, d, "lineitem"), "l_quantity", "l_linestatus")
    return rounded(out.withColumn("u_statistic", F.round("u_statistic", 2)), "p_value", "effect_r").select(
        "group_1", "group_2", "n_1", "n_2", "median_1", "median_2", "u_statistic", "p_value", "effect_r")


_KW = f"""WITH c AS (SELECT c_acctbal AS v, c_mktsegment AS grp, count(*) AS n FROM customer GROUP BY 1, 2),
r AS {q.average_ranks('customer', 'c_acctbal')},
s AS (SELECT grp, 1.0 * sum(c.n) AS n, sum(c.n * r.r) AS rs FROM c JOIN r USING (v) GROUP BY 1),
h AS (SELECT count(*) AS k, sum(n) AS n, sum(rs * rs / n) AS q FROM s),
j AS (SELECT k, n, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - (SELECT sum(1.0 * n * n * n - n) FROM r) / (n * n * n - n))
  AS h FROM h)
SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, CAST(k - 1 AS BIGINT) AS df, round(h, 4) AS h_statistic,
  round({q.chi2_upper('h', 'k - 1')}, 4) AS p_value, round(greatest((h - k + 1) / (n - k), 0), 4) AS eta_squared_h FROM j"""


@register("kruskal_acctbal_by_segment", _KW)
def kruskal(spark, d):
    out = comparisons.kruskal(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return rounded(out, "h_statistic", "p_value", "eta_squared_h").select(
        "k", "n", "df", "h_statistic", "p_value", "eta_squared_h")


@register("group_medians_segment", """SELECT c_mktsegment AS grp, round(quantile_cont(c_acctbal, 0.5), 4) AS median,
  round(avg(c_acctbal), 4) AS group_mean FROM customer GROUP BY 1""")
def medians(spark, d):
    c = table(spark, d, "customer")
    means = summaries.group_summary(c, "c_acctbal", "c_mktsegment").select("grp", sc.r4("mean").alias("group_mean"))
    return rounded(summaries.group_medians(c, "c_acctbal", "c_mktsegment"), "median").join(means, "grp")


_LEVENE = f"""WITH m AS (SELECT c_mktsegment AS grp, quantile_cont(c_acctbal, 0.5) AS med FROM customer GROUP BY 1),
x AS (SELECT grp, abs(c_acctbal - med) AS z FROM customer JOIN m ON c_mktsegment = grp),
g AS (SELECT grp, count(*) AS n, avg(z) AS m, var_samp(z) AS v FROM x GROUP BY 1),
a AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) / sum(n) AS gm, sum((n - 1) * v) AS ssw FROM g),
f AS (SELECT k, n, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM a, (SELECT sum(g.n * pow(g.m - a.gm, 2)) AS ssb FROM g, a))
SELECT CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(f, 4) AS levene_f,
  round({q.f_upper('f', 'k - 1', 'n - k')}, 4) AS levene_p FROM f"""


@register("levene_acctbal_by_segment", _LEVENE)
def levene(spark, d):
    return rounded(comparisons.levene(table(spark, d, "customer"), "c_acctbal", "c_mktsegment"), "levene_f", "levene_p")


# --- crosstab ----------------------------------------------------------------------

_CELLS = """c AS (SELECT l_returnflag AS v1, l_linestatus AS v2, count(*) AS n FROM lineitem GROUP BY 1, 2),
r AS (SELECT v1, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT v2, sum(n) AS cn FROM c GROUP BY 1),
g AS (SELECT r.v1, k.v2, coalesce(c.n, 0) AS n, rn, cn, (SELECT sum(n) FROM c) AS total,
  1.0 * rn * cn / (SELECT sum(n) FROM c) AS e FROM r CROSS JOIN k LEFT JOIN c ON c.v1 = r.v1 AND c.v2 = k.v2)"""
_V_LABEL = ("CASE WHEN {v} < 0.1 THEN 'negligible' WHEN {v} < 0.3 THEN 'small' WHEN {v} < 0.5 THEN 'moderate' "
            "ELSE 'large' END")


@register("chi2_flag_by_status", f"""WITH {_CELLS},
s AS (SELECT sum(pow(n - e, 2) / e) AS chi2, max(total) AS n, min(e) AS me FROM g),
t AS (SELECT s.*, (SELECT count(*) FROM r) - 1 AS a, (SELECT count(*) FROM k) - 1 AS b FROM s),
u AS (SELECT *, a * b AS dof, sqrt(chi2 / (n * greatest(least(a, b), 1))) AS v FROM t)
SELECT round(chi2, 4) AS chi2, CAST(dof AS BIGINT) AS dof, CAST(n AS BIGINT) AS n, round(v, 4) AS cramers_v,
  {_V_LABEL.format(v='v')} AS effect_size, round(me, 4) AS min_expected,
  round({q.chi2_upper('chi2', 'dof')}, 4) AS p_value FROM u""")
def chi2(spark, d):
    out = crosstab.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(out, "chi2", "cramers_v", "min_expected", "p_value").drop("significance", "p_display")


@register("chi2_yates_quality_toxic", f"""WITH c AS (SELECT quality AS v1, toxic AS v2, count(*) AS n FROM labels GROUP BY 1, 2),
r AS (SELECT v1, sum(n) AS rn FROM c GROUP BY 1), k AS (SELECT v2, sum(n) AS cn FROM c GROUP BY 1),
g AS (SELECT coalesce(c.n, 0) AS n, 1.0 * rn * cn / (SELECT sum(n) FROM c) AS e FROM r CROSS JOIN k
  LEFT JOIN c ON c.v1 = r.v1 AND c.v2 = k.v2),
s AS (SELECT sum(pow(abs(n - e) - least(0.5, abs(n - e)), 2) / e) AS chi2, sum(n) AS n FROM g),
u AS (SELECT chi2, n, sqrt(chi2 / n) AS v FROM s)
SELECT round(chi2, 4) AS chi2, CAST(1 AS BIGINT) AS dof, CAST(n AS BIGINT) AS n, round(v, 4) AS cramers_v,
  {_V_LABEL.format(v='v')} AS effect_size, round({q.normal_two_sided('sqrt(chi2)')}, 4) AS p_value FROM u""")
def chi2_yates(spark, d):
    out = crosstab.chi_square(table(spark, d, "labels"), "quality", "toxic")
    return rounded(out, "chi2", "cramers_v", "p_value").drop("significance", "p_display", "min_expected")


@register("chi2_by_segment", f"""WITH c AS (SELECT o_orderpriority AS seg, o_orderstatus AS v1, CAST(o_custkey % 2 AS BIGINT) AS v2,
  count(*) AS n FROM orders GROUP BY 1, 2, 3),
r AS (SELECT seg, v1, sum(n) AS rn FROM c GROUP BY 1, 2), k AS (SELECT seg, v2, sum(n) AS cn FROM c GROUP BY 1, 2),
t AS (SELECT seg, sum(n) AS total FROM c GROUP BY 1),
g AS (SELECT r.seg, coalesce(c.n, 0) AS n, 1.0 * rn * cn / total AS e, total FROM r JOIN k USING (seg) JOIN t USING (seg)
  LEFT JOIN c ON c.seg = r.seg AND c.v1 = r.v1 AND c.v2 = k.v2)
SELECT seg AS o_orderpriority, round(sum(pow(n - e, 2) / e), 4) AS chi2, CAST(max(total) AS BIGINT) AS n,
  round(min(e), 4) AS min_expected FROM g GROUP BY 1""")
def chi2_by(spark, d):
    o = table(spark, d, "orders").withColumn("parity", F.col("o_custkey") % 2)
    out = crosstab.chi_square(o, "o_orderstatus", "parity", ["o_orderpriority"])
    return rounded(out, "chi2", "min_expected").select("o_orderpriority", "chi2", "n", "min_expected")


@register("crosstab_flag_status", """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'Col Total' ELSE l_returnflag END AS row_label,
  CASE WHEN grouping(l_linestatus) = 1 THEN 'Row Total' ELSE l_linestatus END AS col_label, count(*) AS n
FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def margins(spark, d):
    return crosstab.with_margins(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@register("crosstab_wide", """SELECT l_returnflag AS v1, count(*) FILTER (l_linestatus = 'F') AS F,
  count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1""")
def wide(spark, d):
    return crosstab.wide(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@register("residuals_flag_status", f"""WITH {_CELLS} SELECT v1, v2, CAST(n AS BIGINT) AS n, round(e, 4) AS expected,
  round((n - e) / sqrt(e), 4) AS residual FROM g""")
def residuals(spark, d):
    out = crosstab.residuals(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")
    return rounded(out, "expected", "residual").select("v1", "v2", "n", "expected", "residual")


@register("row_percent_flag_status", """SELECT l_returnflag AS v1, l_linestatus AS v2, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY l_returnflag), 4) AS percent FROM lineitem GROUP BY 1, 2""")
def row_percent(spark, d):
    return rounded(crosstab.row_percents(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"), "percent")


# --- correlation and regression -------------------------------------------------------

def _pairs_sql(source: str, with_p: bool = True) -> str:
    parts = []
    for i, a in enumerate(LINE_NUMS):
        for b in LINE_NUMS[i + 1:]:
            parts.append(f"SELECT '{a}' AS variable_1, '{b}' AS variable_2, corr({a}, {b}) AS r, count(*) AS n FROM {source}")
    union = " UNION ALL ".join(parts)
    label = ("CASE WHEN abs(r) < 0.1 THEN 'negligible' WHEN abs(r) < 0.3 THEN 'weak' WHEN abs(r) < 0.5 THEN 'moderate' "
             "WHEN abs(r) < 0.7 THEN 'strong' ELSE 'very strong' END")
    p = q.t_two_sided("r * sqrt((n - 2) / (1 - r * r))", "n - 2")
    return f"""SELECT variable_1, variable_2, round(r, 4) AS r, n, round(p, 4) AS p_value, {q.stars('p')} AS significance,
  concat(CASE WHEN r > 0 THEN 'positive ' ELSE 'negative ' END, {label}) AS strength
FROM (SELECT *, {p} AS p FROM ({union}))"""


@register("pearson_lineitem", _pairs_sql("lineitem"))
def pearson(spark, d):
    return rounded(correlation.pearson(table(spark, d, "lineitem"), LINE_NUMS), "r", "p_value").drop("p_display")


_RANKED = "(SELECT " + ", ".join(f"r{i}.r AS {c}" for i, c in enumerate(LINE_NUMS)) + " FROM lineitem " + " ".join(
    f"JOIN {q.average_ranks('lineitem', c)} AS r{i} ON lineitem.{c} = r{i}.v" for i, c in enumerate(LINE_NUMS)) + ")"


@register("spearman_lineitem", "WITH ranked AS MATERIALIZED " + _RANKED + " " + _pairs_sql("ranked"))
def spearman(spark, d):
    return rounded(correlation.spearman(table(spark, d, "lineitem"), LINE_NUMS), "r", "p_value").drop("p_display")


@register("smallest_p_lineitem", f"SELECT min(p_value) AS min_p FROM ({_pairs_sql('lineitem')})")
def smallest_p(spark, d):
    return rounded(correlation.smallest_p(correlation.pearson(table(spark, d, "lineitem"), LINE_NUMS)), "min_p")


@register("correlation_bubbles", f"SELECT variable_1, variable_2, r, round(abs(r) * 500 + 30, 2) AS bubble_size, "
          f"CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END AS sign FROM ({_pairs_sql('lineitem')})")
def bubbles(spark, d):
    pairs = rounded(correlation.pearson(table(spark, d, "lineitem"), LINE_NUMS), "r")
    return correlation.heat_map(pairs).withColumn("bubble_size", F.round("bubble_size", 2))


@register("average_ranks_quantity", f"SELECT v AS l_quantity, n, r AS rank FROM {q.average_ranks('lineitem', 'l_quantity')}")
def average_ranks(spark, d):
    return ranks.average_ranks(table(spark, d, "lineitem"), "l_quantity").select("l_quantity", "n", "rank")


_SIMPLE = f"""WITH s AS (SELECT count(*) AS n, regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity)
  AS a, var_samp(l_quantity) * (count(*) - 1) AS sxx, var_samp(l_extendedprice) * (count(*) - 1) AS syy,
  covar_samp(l_quantity, l_extendedprice) * (count(*) - 1) AS sxy, avg(l_quantity) AS mx FROM lineitem),
m AS (SELECT *, (syy - b * sxy) / (n - 2) AS mse, b * sxy / syy AS r2 FROM s),
c AS (SELECT 0 AS position, '(Intercept)' AS predictor, a AS b, sqrt(mse * (1.0 / n + mx * mx / sxx)) AS se, n FROM m
  UNION ALL SELECT 1, 'l_quantity', b, sqrt(mse / sxx), n FROM m)"""
_MULTI = """WITH s AS (SELECT count(*) AS n, avg(l_extendedprice) AS my, avg(l_quantity) AS m1, avg(l_discount) AS m2,
  var_samp(l_quantity) AS v1, var_samp(l_discount) AS v2, covar_samp(l_quantity, l_discount) AS v12,
  covar_samp(l_quantity, l_extendedprice) AS c1, covar_samp(l_discount, l_extendedprice) AS c2,
  var_samp(l_extendedprice) AS vy FROM lineitem),
b AS (SELECT *, v1 * v2 - v12 * v12 AS det, (v2 * c1 - v12 * c2) / (v1 * v2 - v12 * v12) AS b1,
  (v1 * c2 - v12 * c1) / (v1 * v2 - v12 * v12) AS b2 FROM s),
m AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, (vy - b1 * c1 - b2 * c2) * (n - 1) / (n - 3) AS mse,
  (b1 * c1 + b2 * c2) / vy AS r2 FROM b),
c AS (SELECT 0 AS position, '(Intercept)' AS predictor, b0 AS b, sqrt(mse * (1.0 / n + (m1 * m1 * v2 - 2 * m1 * m2 * v12
  + m2 * m2 * v1) / det / (n - 1))) AS se, n FROM m
  UNION ALL SELECT 1, 'l_quantity', b1, sqrt(mse * v2 / det / (n - 1)), n FROM m
  UNION ALL SELECT 2, 'l_discount', b2, sqrt(mse * v1 / det / (n - 1)), n FROM m)"""


def _coef_sql(ctes: str, k: int) -> str:
    return f"""{ctes} SELECT CAST(position AS INTEGER) AS position, predictor, round(b, 4) AS b, round(se, 4) AS std_error,
  round(b / se, 4) AS t, round(p, 4) AS p, {q.stars('p')} AS significance
FROM (SELECT *, {q.t_two_sided('b / se', f'n - {k + 1}')} AS p FROM c)"""


@register("ols_simple_price_qty", _coef_sql(_SIMPLE, 1))
def ols_simple(spark, d):
    return regression.coef_table(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"])


@register("ols_multi_price", _coef_sql(_MULTI, 2))
def ols_multi(spark, d):
    return regression.coef_table(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])


@register("ols_summary_multi", f"""{_MULTI} SELECT CAST(n AS BIGINT) AS n, CAST(2 AS INTEGER) AS k, round(r2, 6) AS r_squared,
  round(1 - (1 - r2) * (n - 1) / (n - 3), 6) AS adj_r_squared, round((r2 / 2) / ((1 - r2) / (n - 3)), 4) AS f_statistic,
  round({q.f_upper('(r2 / 2) / ((1 - r2) / (n - 3))', '2', 'n - 3')}, 4) AS p_value FROM m""")
def ols_summary(spark, d):
    out = regression.model_summary(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return rounded(out, "f_statistic", "p_value").withColumns(
        {c: F.round(c, 6) for c in ("r_squared", "adj_r_squared")}).drop("equation", "p_display", "significance")


@register("ols_equation_simple", f"""{_SIMPLE} SELECT concat('ŷ=', CAST(round(a, 4) AS VARCHAR), '+', CAST(round(b, 4) AS VARCHAR),
  '×l_quantity') AS equation FROM m""")
def ols_equation(spark, d):
    return regression.model_summary(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"]).select("equation")


@register("ols_by_segment", """SELECT l_returnflag, count(*) AS n, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept,
  round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r_squared
FROM lineitem GROUP BY 1""")
def ols_by(spark, d):
    c = regression.coefficients(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity"], ["l_returnflag"])
    return c.groupBy("l_returnflag").agg(
        F.max("n").alias("n"), sc.r4(F.max(F.when(F.col("position") == 0, F.col("b")))).alias("intercept"),
        sc.r4(F.max(F.when(F.col("position") == 1, F.col("b")))).alias("slope"),
        F.round(F.max("r_squared"), 6).alias("r_squared"))


@register("ols_residuals", """WITH s AS (SELECT regr_slope(c_acctbal, c_nationkey) AS b, regr_intercept(c_acctbal, c_nationkey) AS a
  FROM customer) SELECT c_custkey, round(a + b * c_nationkey, 4) AS fitted, round(c_acctbal - a - b * c_nationkey, 4)
  AS residual FROM customer, s""")
def ols_residuals(spark, d):
    out = regression.residual_rows(table(spark, d, "customer"), "c_acctbal", ["c_nationkey"], ["c_custkey"])
    return rounded(out, "fitted", "residual").select("c_custkey", "fitted", "residual")


# --- reliability and descriptives ---------------------------------------------------------

_ITEMS = ["l_quantity", "l_discount", "l_tax"]


@register("cronbach_lineitem", """SELECT count(*) AS n, CAST(3 AS INTEGER) AS n_items, round(3 / 2.0 * (1 - (var_samp(l_quantity)
  + var_samp(l_discount) + var_samp(l_tax)) / var_samp(l_quantity + l_discount + l_tax)), 4) AS alpha,
  'unacceptable' AS effect_size FROM lineitem""")
def cronbach(spark, d):
    return rounded(comparisons.reliability(table(spark, d, "lineitem"), _ITEMS), "alpha").drop("error")


@register("item_totals_lineitem", " UNION ALL ".join(
    f"SELECT '{c}' AS item, round(var_samp({c}), 4) AS item_variance, round(corr({c}, "
    f"{' + '.join(x for x in _ITEMS if x != c)}), 4) AS item_total_correlation FROM lineitem" for c in _ITEMS))
def item_totals(spark, d):
    return comparisons.item_totals(table(spark, d, "lineitem"), _ITEMS)


def _describe_sql(tbl: str, cols: list[str], by: str = "") -> str:
    parts = []
    key = f"{by}, " if by else ""
    join = f" JOIN (SELECT {by} AS _b, %s FROM {tbl} GROUP BY 1) z ON {by} = _b" if by else f", (SELECT %s FROM {tbl}) z"
    for c in cols:
        head = (f"avg({c}) AS m0")
        g1 = "(avg(d * d * d) / pow(avg(d * d), 1.5))"
        g2 = "(avg(d * d * d * d) / pow(avg(d * d), 2) - 3)"
        inner = f"SELECT {key}{c} AS x, {c} - m0 AS d FROM {tbl}{join % head}"
        parts.append(f"""SELECT {key}'{c}' AS variable, count(x) AS n, CAST(count(*) - count(x) AS BIGINT) AS missing,
  round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median, round(stddev_samp(x), 4) AS std_dev,
  round(CAST(min(x) AS DOUBLE), 4) AS min, round(CAST(max(x) AS DOUBLE), 4) AS max, round(quantile_cont(x, 0.25), 4) AS q1,
  round(quantile_cont(x, 0.75), 4) AS q3,
  round({g1} * sqrt(count(x) * (count(x) - 1.0)) / (count(x) - 2.0), 4) AS skewness,
  round((count(x) - 1.0) / ((count(x) - 2.0) * (count(x) - 3.0)) * ((count(x) + 1.0) * {g2} + 6.0), 4) AS kurtosis
FROM ({inner}) GROUP BY ALL""" if by else f"""SELECT '{c}' AS variable, count(x) AS n, CAST(count(*) - count(x) AS BIGINT) AS missing,
  round(avg(x), 4) AS mean, round(quantile_cont(x, 0.5), 4) AS median, round(stddev_samp(x), 4) AS std_dev,
  round(CAST(min(x) AS DOUBLE), 4) AS min, round(CAST(max(x) AS DOUBLE), 4) AS max, round(quantile_cont(x, 0.25), 4) AS q1,
  round(quantile_cont(x, 0.75), 4) AS q3,
  round({g1} * sqrt(count(x) * (count(x) - 1.0)) / (count(x) - 2.0), 4) AS skewness,
  round((count(x) - 1.0) / ((count(x) - 2.0) * (count(x) - 3.0)) * ((count(x) + 1.0) * {g2} + 6.0), 4) AS kurtosis
FROM ({inner})""")
    return " UNION ALL ".join(parts)


@register("describe_numeric", _describe_sql("lineitem", LINE_NUMS))
def describe(spark, d):
    return summaries.describe(table(spark, d, "lineitem"), LINE_NUMS)


@register("describe_by_flag", _describe_sql("lineitem", ["l_quantity", "l_extendedprice"], "l_returnflag"))
def describe_by(spark, d):
    return summaries.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_returnflag"])


_JB = """(SELECT n, n / 6.0 * (g1 * g1 + g2 * g2 / 4) AS jb, exp(-n / 12.0 * (g1 * g1 + g2 * g2 / 4)) AS p FROM (SELECT count({c}) AS n,
  avg(pow({c} - m, 3)) / pow(avg(pow({c} - m, 2)), 1.5) AS g1, avg(pow({c} - m, 4)) / pow(avg(pow({c} - m, 2)), 2) - 3 AS g2
  FROM {t}, (SELECT avg({c}) AS m FROM {t})))"""


_LONG = " UNION ALL ".join(f"SELECT '{c}' AS variable, {c} AS x FROM lineitem" for c in LINE_NUMS)


@register("describe_with_normality", f"""SELECT d.*, j.p AS normality_p, round(w.p, 4) AS shapiro_p FROM ({_describe_sql('lineitem', LINE_NUMS)}) d
JOIN ({" UNION ALL ".join(f"SELECT '{c}' AS variable, round(p, 4) AS p FROM {_JB.format(c=c, t='lineitem')}" for c in LINE_NUMS)}) j USING (variable)
JOIN {q.shapiro_wilk(_LONG, "variable")} w USING (variable)""")
def describe_normality(spark, d):
    return summaries.describe(table(spark, d, "lineitem"), LINE_NUMS, normality=True)


@register("shapiro_lineitem", f"SELECT variable, n, round(w, 6) AS w, round(p, 6) AS p FROM {q.shapiro_wilk(_LONG, 'variable')}")
def shapiro_lineitem(spark, d):
    """W of whole columns of any length, with many ties."""
    out = normality.shapiro_table(table(spark, d, "lineitem"), LINE_NUMS)
    return out.select("variable", "n", F.round("w", 6).alias("w"), F.round("p", 6).alias("p"))


@register("skew_notes", f"""SELECT variable, CASE WHEN abs(skewness) < 0.5 THEN 'approximately symmetric' WHEN skewness > 0 THEN
  'positively skewed' ELSE 'negatively skewed' END AS shape FROM ({_describe_sql('events', ['value', 'user_id'])})""")
def skew_notes(spark, d):
    return summaries.skew_notes(summaries.describe(table(spark, d, "events"), ["value", "user_id"])).select("variable", "shape")


@register("freq_categorical", " UNION ALL ".join(
    f"SELECT '{c}' AS variable, {c} AS category, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 2) AS percent "
    "FROM lineitem GROUP BY 2" for c in ("l_returnflag", "l_linestatus")))
def freq(spark, d):
    return summaries.frequencies(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


# --- normality, assumptions, selection -----------------------------------------------------

@register("shapiro_customer", f"""SELECT c_mktsegment, 'c_acctbal' AS variable, n, round(w, 4) AS w, round(p, 4) AS p
FROM {q.shapiro_wilk("SELECT c_mktsegment, c_acctbal AS x FROM customer", "c_mktsegment")}""")
def shapiro(spark, d):
    c = table(spark, d, "customer")
    return rounded(normality.shapiro_table(c, ["c_acctbal"], ["c_mktsegment"]), "w", "p")


@register("jarque_bera_lineitem", """WITH s AS (SELECT avg(l_quantity) AS m FROM lineitem),
g AS (SELECT count(*) AS n, avg(pow(l_quantity - m, 3)) / pow(avg(pow(l_quantity - m, 2)), 1.5) AS g1,
  avg(pow(l_quantity - m, 4)) / pow(avg(pow(l_quantity - m, 2)), 2) - 3 AS g2 FROM lineitem, s)
SELECT 'l_quantity' AS variable, n, round(n / 6.0 * (g1 * g1 + g2 * g2 / 4), 3) AS jb,
  round(exp(-n / 12.0 * (g1 * g1 + g2 * g2 / 4)), 4) AS p FROM g""")
def jarque_bera(spark, d):
    out = normality.jarque_bera(table(spark, d, "lineitem"), ["l_quantity"])
    return out.select("variable", "n", F.round("jb", 3).alias("jb"), sc.r4("p").alias("p"))


@register("assumptions_ttest")
def assumptions_ttest(spark, d):
    return assumptions.check_assumptions(table(spark, d, "lineitem"), "t_test",
                                         {"numeric_var": "l_quantity", "group_var": "l_linestatus"}, LINE_KEY)


_LIN_RESID = "SELECT a + b * l_quantity AS f, l_extendedprice - a - b * l_quantity AS e FROM lineitem, s"


@register("assumptions_without_normality", f"""WITH q AS (SELECT quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3
  FROM lineitem), s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
{_CELLS}
SELECT 't_test' AS test, 'sample_size' AS check_id, count(*) >= 30 AS passed, CAST(count(*) AS DOUBLE) AS measure FROM lineitem
UNION ALL SELECT 't_test', 'outliers', count(*) FILTER (l_quantity < q1 - 3 * (q3 - q1) OR l_quantity > q3 + 3 * (q3 - q1)) = 0,
  CAST(count(*) FILTER (l_quantity < q1 - 3 * (q3 - q1) OR l_quantity > q3 + 3 * (q3 - q1)) AS DOUBLE) FROM lineitem, q
UNION ALL SELECT 'regression', 'homoscedasticity', abs(corr(f, abs(e))) < 0.3, round(corr(f, abs(e)), 4) FROM ({_LIN_RESID})
UNION ALL SELECT 'regression', 'multicollinearity', greatest(abs(corr(l_quantity, l_discount)), abs(corr(l_quantity, l_tax)),
  abs(corr(l_discount, l_tax))) < 0.9, round(greatest(abs(corr(l_quantity, l_discount)), abs(corr(l_quantity, l_tax)),
  abs(corr(l_discount, l_tax))), 4) FROM lineitem
UNION ALL SELECT 'chi_square', 'expected_counts', min(e) >= 5, round(min(e), 4) FROM g""")
def checks_plain(spark, d):
    li = table(spark, d, "lineitem")
    resid = regression.residual_rows(li, "l_extendedprice", ["l_quantity"])
    parts = [assumptions.sample_size_check(li, "t_test", "l_quantity"), assumptions.outlier_check(li, "t_test", "l_quantity"),
             assumptions.homoscedasticity_check(resid),
             assumptions.multicollinearity_check(summaries.numeric(li, _ITEMS), _ITEMS),
             assumptions.expected_count_check(li, "l_returnflag", "l_linestatus")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("test", "check_id", "passed", sc.r4("measure").alias("measure"))


_GATE = """WITH k AS (SELECT o_orderstatus AS test, concat(o_orderpriority, '/', CAST(o_custkey % 4 AS VARCHAR)) AS check_id,
  avg(o_totalprice) > 250000 AS passed FROM orders GROUP BY 1, 2),
s AS (SELECT test, round(avg(CASE WHEN passed THEN 1.0 ELSE 0.0 END), 4) AS score, count(*) FILTER (passed) AS pc, count(*) AS tc,
  string_agg(check_id, ', ' ORDER BY check_id) FILTER (NOT passed) AS failed FROM k GROUP BY 1)
SELECT test, score, pc AS passed_count, tc AS total_count, score >= 0.6 AS sound,
  CASE WHEN score >= 0.6 THEN concat('This test is statistically sound for your data (score: ', printf('%.1f', score * 100), '%).',
    CASE WHEN score < 0.8 THEN ' Consider reviewing the assumption details below.' ELSE '' END)
  ELSE concat('This test may NOT be appropriate for your data (score: ', printf('%.1f', score * 100), '%). Failed assumptions: ',
    failed, '. Consider using an alternative test.') END AS recommendation FROM s"""


@register("soundness_rows", _GATE)
def soundness_rows(spark, d):
    """Score and verdict over check rows, here whether each slice of orders passes a mean threshold."""
    o = table(spark, d, "orders")
    name = F.concat(F.col("o_orderpriority"), F.lit("/"), (F.col("o_custkey") % 4).cast("string"))
    checks = o.groupBy(F.col("o_orderstatus").alias("test"), name.alias("check_id")).agg(
        (F.avg("o_totalprice") > 250000).alias("passed")).withColumn("name", F.col("check_id"))
    return assumptions.soundness(assumptions.score(checks))


STUDY = {
    "descriptive": {"columns": ["l_quantity", "l_extendedprice", "l_returnflag"]},
    "chi_square": {"var1": "l_returnflag", "var2": "l_linestatus"},
    "t_test": {"numeric_var": "l_quantity", "group_var": "l_linestatus"},
    "anova": {"numeric_var": "l_quantity", "group_var": "l_returnflag"},
    "correlation": {"columns": LINE_NUMS, "method": "pearson"},
    "regression": {"dependent": "l_extendedprice", "predictors": ["l_quantity", "l_discount"]},
    "reliability": {"columns": _ITEMS},
}
_META_COLS = ["l_quantity", "l_extendedprice", "l_linenumber", "l_returnflag", "l_linestatus"]


@register("study_soundness")
def study_soundness(spark, d):
    return study.soundness_table(table(spark, d, "lineitem"), STUDY, LINE_KEY)


@register("study_validation")
def study_validation(spark, d):
    config = STUDY | {"t_test": {"numeric_var": "l_quantity", "group_var": "l_returnflag"}, "reliability": None}
    return study.validate(table(spark, d, "lineitem"), config, LINE_KEY)


@register("study_report")
def study_report(spark, d):
    return study.combined_report(study.run_study(table(spark, d, "lineitem"), STUDY, LINE_KEY))


@register("column_metadata", " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS position, '{c}' AS name, '{'categorical' if c in ('l_returnflag', 'l_linestatus') else 'numeric'}' "
    f"AS dtype, count(DISTINCT {c}) AS n_unique FROM lineitem" for i, c in enumerate(_META_COLS, 1)))
def metadata(spark, d):
    return study.column_metadata(table(spark, d, "lineitem"), _META_COLS).select("position", "name", "dtype", "n_unique")


@register("recommend_tests", """WITH u AS (SELECT count(DISTINCT l_quantity) AS a, count(DISTINCT l_linenumber) AS b,
  count(DISTINCT l_returnflag) AS c, count(DISTINCT l_linestatus) AS e FROM lineitem)
SELECT 'descriptive' AS test, CAST(1 AS INTEGER) AS priority FROM u WHERE a > 5
UNION ALL SELECT 'chi_square', 2 FROM u WHERE b <= 10 OR c > 0
UNION ALL SELECT 't_test', 2 FROM u WHERE a > 5 AND e = 2
UNION ALL SELECT 'anova', 3 FROM u WHERE a > 5 AND (c >= 3 OR (b <= 10 AND b >= 3))
UNION ALL SELECT 'correlation', 2 FROM u WHERE a > 5
UNION ALL SELECT 'regression', 3 FROM u WHERE a > 5
UNION ALL SELECT 'mann_whitney', 4 FROM u WHERE a > 5 AND e = 2""")
def recommend(spark, d):
    return study.recommend(study.column_metadata(table(spark, d, "lineitem"), _META_COLS)).select("test", "priority")


@register("suggest_variables")
def suggest(spark, d):
    meta = study.column_metadata(table(spark, d, "lineitem"), _META_COLS).collect()
    rows = [(t, str(p)) for t, p in study.suggest(meta).items()]
    return literal_rows(spark, rows, "test string, params string")


# --- texts ----------------------------------------------------------------------

@register("citation_anova", f"""WITH {_ANOVA}
SELECT printf('F(%d,%d)=%.2f, %s, η²=%.3f', CAST(k - 1 AS BIGINT), CAST(n - k AS BIGINT), f, {q.p_text('p')}, ssb / (ssb + ssw))
  AS citation FROM (SELECT *, {q.f_upper('f', 'k - 1', 'n - k')} AS p FROM f)""")
def citation_anova(spark, d):
    out = comparisons.anova(table(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return out.select(interpret.citation("anova").alias("citation"))


def _label(kind: str, value: str) -> str:
    """The effect label by the cuts of its kind."""
    cuts, top = fv.EFFECT_CUTS[kind]
    return "CASE " + " ".join(f"WHEN {value} < {cut} THEN '{text}'" for cut, text in cuts) + f" ELSE '{top}' END"


@register("result_sheet_anova", f"""WITH {_ANOVA}, r AS (SELECT *, ssb / (ssb + ssw) AS eta, {q.f_upper('f', 'k - 1', 'n - k')} AS p FROM f)
SELECT CAST(0 AS INTEGER) AS position, 'Analysis' AS metric, 'One-Way ANOVA' AS value FROM r
UNION ALL SELECT 1, 'p-value', {q.p_text('p')} FROM r UNION ALL SELECT 2, 'Significance', {q.stars('p')} FROM r
UNION ALL SELECT 3, 'Effect Size', concat('η² = ', regexp_replace(regexp_replace(printf('%.4f', eta), '0+$', ''), '\\.$', '.0')) FROM r
UNION ALL SELECT 4, 'APA Citation', printf('F(%d,%d)=%.2f, %s, η²=%.3f', CAST(k - 1 AS BIGINT), CAST(n - k AS BIGINT), f, {q.p_text('p')}, eta) FROM r
UNION ALL SELECT 5, 'Interpretation', concat(printf('One-way ANOVA compared o_totalprice across %d groups of o_orderpriority. Result was %s, F(%d,%d)=%.2f, %s, η²=%.3f (%s effect). We %s the null hypothesis of equal means.',
  CAST(k AS BIGINT), CASE WHEN p < 0.05 THEN 'statistically significant' ELSE 'not statistically significant' END, CAST(k - 1 AS BIGINT), CAST(n - k AS BIGINT), f, {q.p_text('p')}, eta,
  {_label('eta_squared', 'eta')}, CASE WHEN p < 0.05 THEN 'reject' ELSE 'fail to reject' END), CASE WHEN p < 0.05 THEN ' Bonferroni post-hoc comparisons provided.' ELSE '' END) FROM r""")
def result_sheet(spark, d):
    done = study.run_test(table(spark, d, "orders"), "anova", {"numeric_var": "o_totalprice", "group_var": "o_orderpriority"})
    return study.result_sheet(done)


@register("interpretation_by_segment")
def interpretation(spark, d):
    out = comparisons.t_test(table(spark, d, "lineitem"), "l_quantity", "l_linestatus", ["l_returnflag"])
    return interpret.interpret(out, "t_test", {}, ["l_returnflag"])


@register("interpretation_correlation", f"""WITH p AS ({_pairs_sql('lineitem')}),
b AS (SELECT *, (SELECT count(*) FROM p) AS k FROM p ORDER BY abs(r) DESC LIMIT 1)
SELECT 'executive' AS mode, concat('The strongest relationship in your data is between ', variable_1, ' and ', variable_2, ' (r = ',
  CAST(r AS VARCHAR), ', ', CASE WHEN p_value < 0.001 THEN 'p < .001' ELSE printf('p = %.3f', p_value) END, '): a ', strength,
  ' correlation. See the heatmap for all variable relationships.') AS text FROM b""")
def interpretation_correlation(spark, d):
    best = interpret.strongest_pair(correlation.pearson(table(spark, d, "lineitem"), LINE_NUMS), "pearson")
    return interpret.interpret(best, "correlation", {}, modes=["executive"]).select("mode", "text")


@register("significance_texts", f"""SELECT l_discount AS p, {q.stars('l_discount')} AS stars, {q.p_text('l_discount')} AS p_text,
  CASE WHEN l_discount < 0.001 THEN '< .001' ELSE printf('= %.3f', l_discount) END AS report,
  CASE WHEN l_discount < 0.05 THEN 'statistically significant' ELSE 'not statistically significant' END AS verdict,
  CASE WHEN l_discount < 0.05 THEN 'reject' ELSE 'fail to reject' END AS decision, count(*) AS n FROM lineitem GROUP BY 1""")
def significance_texts(spark, d):
    p = F.col("p")
    return (table(spark, d, "lineitem").groupBy(F.col("l_discount").alias("p")).agg(F.count("*").alias("n"))
            .select("p", "n", sc.stars(p).alias("stars"), sc.p_text(p).alias("p_text"), sc.p_report(p).alias("report"),
                    sc.verdict(p).alias("verdict"), sc.decision(p).alias("decision")))


def _label_sql(v: str, cuts: list[tuple], top: str) -> str:
    return "CASE " + " ".join(f"WHEN {v} < {c} THEN '{n}'" for c, n in cuts) + f" ELSE '{top}' END"


@register("effect_labels", f"""WITH v AS (SELECT p_size, p_size / 50.0 AS x, count(*) AS n FROM part GROUP BY 1)
SELECT p_size, n, {_label_sql('x', [(0.1, 'negligible'), (0.3, 'small'), (0.5, 'moderate')], 'large')} AS v_label,
  {_label_sql('x', [(0.2, 'negligible'), (0.5, 'small'), (0.8, 'medium')], 'large')} AS d_label,
  {_label_sql('x', [(0.06, 'small'), (0.14, 'medium')], 'large')} AS eta_label,
  {_label_sql('x', [(0.5, 'unacceptable'), (0.6, 'poor'), (0.7, 'questionable'), (0.8, 'acceptable'), (0.9, 'good')], 'excellent')}
  AS alpha_label, concat('negative ', {_label_sql('x', [(0.1, 'negligible'), (0.3, 'weak'), (0.5, 'moderate'), (0.7, 'strong')], 'very strong')})
  AS r_label FROM v""")
def effect_labels(spark, d):
    x = F.col("p_size") / 50.0
    return table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).select(
        "p_size", "n", sc.effect_label("cramers_v", x).alias("v_label"), sc.effect_label("cohens_d", x).alias("d_label"),
        sc.effect_label("eta_squared", x).alias("eta_label"), sc.effect_label("alpha", x).alias("alpha_label"),
        sc.strength_text(-x).alias("r_label"))


@register("effect_texts", """SELECT p_size, count(*) AS n, CASE WHEN p_size % 3 = 0 THEN concat('Cohen''s d = ', CAST(p_size AS VARCHAR), '.5')
  WHEN p_size % 3 = 1 THEN concat('η² = ', CAST(p_size AS VARCHAR), '.5') ELSE '—' END AS effect,
  CAST(CASE WHEN p_size % 3 = 2 THEN 2 ELSE 3 END + 1 AS INTEGER) AS chips FROM part GROUP BY 1""")
def effect_texts(spark, d):
    size = F.col("p_size")
    shift = (size + 0.5).cast("double")
    dd, eta = F.when(size % 3 == 0, shift), F.when(size % 3 == 1, shift)
    chips = sc.headline_chips(F.lit(0.04), n=F.col("n"), cohens_d=dd, eta_squared=eta)
    return table(spark, d, "part").groupBy("p_size").agg(F.count("*").alias("n")).select(
        "p_size", "n", sc.effect_text(cohens_d=dd, eta_squared=eta).alias("effect"), F.size(chips).alias("chips"))


@register("zscore_fences", """SELECT 'c_acctbal' AS variable, round(avg(c_acctbal) - 3 * stddev_samp(c_acctbal), 4) AS low,
  round(avg(c_acctbal) + 3 * stddev_samp(c_acctbal), 4) AS high FROM customer""")
def zscore_fences(spark, d):
    return rounded(outliers.fences(table(spark, d, "customer"), ["c_acctbal"], "zscore"), "low", "high")
