"""Group comparison tests. Details are reduced to one row per group first; `by` gives one test per segment."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from statloom.functions.scalars import effect_label, p_text, r4, stars
from statloom.functions.tails import chi2_upper, f_upper, normal_quantile, normal_upper, t_quantile, t_two_sided
from statloom.operators.naming import plain_names
from statloom.operators.ranks import average_ranks, counted_quantiles, value_table, with_ranks
from statloom.operators.skew import every_pair, lookup_by_key
from statloom.operators.summaries import group_medians, group_summary, numeric
from statloom.session import settle

# Mann-Whitney is exact when a group has at most this many rows and no value repeats.
EXACT_ROWS = 8


def pooled_sd(n1, v1, n2, v2) -> Column:
    return F.sqrt(F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))


def two_group_row(groups: DataFrame, by: list[str]) -> DataFrame:
    """First and second group side by side, ordered by value, plus the number of groups found."""
    pack = F.struct("grp", "n", "mean", "var", "std_dev")
    return groups.groupBy(*by).agg(F.count("*").alias("groups"), F.min_by(pack, "grp").alias("a"),
                                   F.max_by(pack, "grp").alias("b"))


@plain_names("value", "group", "by")
def t_test(df: DataFrame, value: str, group: str, by: list[str] = (), alpha: float = 0.05) -> DataFrame:
    """Pooled and Welch t side by side; segments without exactly two groups carry an error text instead."""
    by = list(by)
    row = two_group_row(group_summary(df, value, group, by), by)
    n1, n2 = F.col("a.n"), F.col("b.n")
    m1, m2 = F.col("a.mean"), F.col("b.mean")
    v1, v2 = F.coalesce(F.col("a.var"), F.lit(0.0)), F.coalesce(F.col("b.var"), F.lit(0.0))
    md, sp = m1 - m2, pooled_sd(n1, v1, n2, v2)
    s1, s2 = v1 / n1, v2 / n2
    se = F.sqrt(s1 + s2)
    two = F.col("groups") == 2
    base = row.select(
        *by, "groups", F.col("a.grp").alias("group_1"), F.col("b.grp").alias("group_2"),
        n1.alias("n_1"), n2.alias("n_2"), m1.alias("mean_1"), m2.alias("mean_2"),
        F.col("a.std_dev").alias("sd_1"), F.col("b.std_dev").alias("sd_2"),
        F.when(two, md).alias("mean_difference"),
        F.when(two, F.try_divide(md, sp * F.sqrt(1 / n1 + 1 / n2))).alias("t_pooled"),
        F.when(two, (n1 + n2 - 2).cast("double")).alias("df_pooled"),
        F.when(two, F.try_divide(md, se)).alias("t_welch"),
        F.when(two, F.try_divide((s1 + s2) * (s1 + s2),
                                 F.try_divide(s1 * s1, n1 - 1) + F.try_divide(s2 * s2, n2 - 1))).alias("df_welch"),
        F.when(two, F.coalesce(F.try_divide(md, sp), F.lit(0.0))).alias("cohens_d"),
        F.when(two, se).alias("se_welch"),
        F.when(~two, F.format_string("Need exactly 2 groups; found %d", "groups")).alias("error"))
    half = t_quantile(F.lit(1 - alpha / 2), F.col("df_welch")) * F.col("se_welch")
    return (base.withColumn("p_pooled", t_two_sided("t_pooled", "df_pooled"))
            .withColumn("p_welch", t_two_sided("t_welch", "df_welch")).withColumn("_half", half)
            .withColumn("ci_low", F.col("mean_difference") - F.col("_half"))
            .withColumn("ci_high", F.col("mean_difference") + F.col("_half"))
            .withColumn("effect_size", effect_label("cohens_d", F.col("cohens_d")))
            .withColumn("significance", stars(F.col("p_pooled")))
            .withColumn("p_display", p_text(F.col("p_pooled"))).withColumn("p_value", F.col("p_pooled")).drop("_half"))


def anova_from_groups(groups: DataFrame, by: list[str] = ()) -> DataFrame:
    """F test from (n, mean, var) per group: sums of squares about the grand mean, no second pass over details."""
    by = list(by)
    groups = settle(groups)
    grand = groups.groupBy(*by).agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand"))
    beside = lookup_by_key(groups, grand, by) if by else groups.withColumn("_grand", grand.scalar())
    agg = (beside.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.min("n").alias("smallest"),
        F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) * (F.col("mean") - F.col("_grand"))).alias("ss_between"),
        F.sum((F.col("n") - 1) * F.coalesce(F.col("var"), F.lit(0.0))).alias("ss_within")))
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")
    return (agg.withColumn("df_between", F.col("k") - 1).withColumn("df_within", F.col("n") - F.col("k"))
            .withColumn("f_statistic", F.try_divide(F.try_divide(F.col("ss_between"), d1),
                                                    F.try_divide(F.col("ss_within"), d2)))
            .withColumn("eta_squared", F.coalesce(F.try_divide(F.col("ss_between"),
                                                               F.col("ss_between") + F.col("ss_within")), F.lit(0.0)))
            .withColumn("p_value", f_upper("f_statistic", d1, d2)))


@plain_names("value", "group", "by")
def anova(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    out = anova_from_groups(group_summary(df, value, group, by), by).drop("smallest")
    return (out.withColumn("effect_size", effect_label("eta_squared", F.col("eta_squared")))
            .withColumn("significance", stars(F.col("p_value"))).withColumn("p_display", p_text(F.col("p_value"))))


@plain_names("value", "group", "by")
def pairwise_t(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    """Bonferroni-adjusted pooled t for every pair of groups; joins group rows in spread pieces, never detail rows."""
    by = list(by)
    groups = settle(group_summary(df, value, group, by))
    size = groups.groupBy(*by).agg((F.count("*") * (F.count("*") - 1) / 2).cast("long").alias("pairs"))
    groups = lookup_by_key(groups, size, by) if by else groups.withColumn("pairs", size.scalar())
    pack = groups.select(*by, "pairs", F.struct("grp", "n", "mean", "var").alias("g"))
    pairs = every_pair(pack.select(*by, "pairs", F.col("g").alias("a")), pack.select(*by, F.col("g").alias("b")), by)
    pairs = pairs.where(F.col("a.grp") < F.col("b.grp"))
    n1, n2, md = F.col("a.n"), F.col("b.n"), F.col("a.mean") - F.col("b.mean")
    v1, v2 = F.coalesce(F.col("a.var"), F.lit(0.0)), F.coalesce(F.col("b.var"), F.lit(0.0))
    sp = pooled_sd(n1, v1, n2, v2)
    tested = pairs.select(
        *by, F.col("a.grp").alias("group_1"), F.col("b.grp").alias("group_2"),
        md.alias("mean_diff"), F.try_divide(md, sp * F.sqrt(1 / n1 + 1 / n2)).alias("t"),
        (n1 + n2 - 2).cast("double").alias("df"), "pairs")
    adjusted = F.least(t_two_sided("t", "df") * F.col("pairs"), F.lit(1.0))
    return (tested.withColumn("p_bonferroni", adjusted)
            .withColumn("significant", F.when(F.col("p_bonferroni") < 0.05, "Yes").otherwise("No")))


@plain_names("value", "group", "by")
def levene(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    """Equality of variances: F test on distances from the group medians. Null where a group has one row."""
    by = list(by)
    num = numeric(df, [value]).where(F.col(value).isNotNull() & F.col(group).isNotNull())
    med = group_medians(df, value, group, by)
    rows = num.select(*by, F.col(group).alias("grp"), F.col(value).alias("_x"))
    dev = lookup_by_key(rows, med, [*by, "grp"]).withColumn("_dev", F.abs(F.col("_x") - F.col("median")))
    groups = group_summary(dev, "_dev", "grp", by)
    out = anova_from_groups(groups, by)
    ok = (F.col("smallest") >= 2) & (F.col("k") >= 2)
    return out.select(*by, "k", "n", F.when(ok, F.col("f_statistic")).alias("levene_f"),
                      F.when(ok, F.col("p_value")).alias("levene_p"))


def _exact_two_sided(u: float, n1: int, n2: int) -> float:
    """Exact tail of U without ties: counts of rank sums by adding one rank at a time."""
    small, size = min(n1, n2), n1 * n2 + 1
    counts = np.zeros((small + 1, size))
    counts[0, 0] = 1.0
    for rank in range(1, n1 + n2 + 1):
        for j in range(min(rank, small), 0, -1):
            shift = rank - j
            if shift < size:
                counts[j, shift:] += counts[j - 1, :size - shift]
    law = counts[small] / counts[small].sum()
    top = max(u, n1 * n2 - u)
    return min(1.0, 2 * float(law[int(round(top)):].sum()))


@F.pandas_udf(DoubleType())
def _exact_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    cap = [(a, int(b), int(c)) if not (pd.isna(a) or pd.isna(b)) else None for a, b, c in zip(u, n1, n2)]
    return pd.Series([_exact_two_sided(*x) if x else None for x in cap], dtype="float64")


@plain_names("value", "group", "by")
def mann_whitney(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    """U of the first group (by value), tie-corrected normal p with continuity, exact p for small untied groups."""
    by = list(by)
    num = numeric(df, [value]).where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = value_table(num.withColumnRenamed(group, "grp"), value, by, ["grp"])
    ranked = with_ranks(counts, value, by, ["grp"])
    tie = F.col("tie").cast("double")
    per = ranked.groupBy(*by, "grp").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"),
        F.sum(F.col("n") / tie * (tie * tie * tie - tie)).alias("ties"))
    pack = F.struct("grp", "n", "rank_sum")
    row = per.groupBy(*by).agg(F.count("*").alias("groups"), F.min_by(pack, "grp").alias("a"),
                               F.max_by(pack, "grp").alias("b"), F.sum("ties").alias("ties"))
    middle = F.get("q", F.lit(0))
    med = counted_quantiles(counts, value, [0.5], [*by, "grp"]).groupBy(*by).agg(
        F.struct(F.min_by(middle, "grp").alias("m1"), F.max_by(middle, "grp").alias("m2")).alias("_med"))
    row = row.join(med, by) if by else row.withColumn("_med", med.scalar())
    row = row.withColumns({"median_1": F.col("_med.m1"), "median_2": F.col("_med.m2")})
    n1, n2 = F.col("a.n").cast("double"), F.col("b.n").cast("double")
    size = n1 + n2
    u1 = F.col("a.rank_sum") - n1 * (n1 + 1) / 2
    top = F.greatest(u1, n1 * n2 - u1)
    sd = F.sqrt(n1 * n2 / 12 * (size + 1 - F.try_divide(F.col("ties"), size * (size - 1))))
    two = F.col("groups") == 2
    exact = two & (F.least(n1, n2) <= EXACT_ROWS) & (F.col("ties") == 0)
    base = row.select(
        *by, "groups", F.col("a.grp").alias("group_1"), F.col("b.grp").alias("group_2"), "median_1", "median_2",
        F.col("a.n").alias("n_1"), F.col("b.n").alias("n_2"), F.when(two, u1).alias("u_statistic"),
        F.when(two, F.try_divide(top - n1 * n2 / 2 - 0.5, sd)).alias("z"),
        F.when(exact, u1).alias("_u_exact"),
        F.when(~two, F.lit("Requires exactly 2 groups.")).alias("error"))
    normal = F.least(F.lit(1.0), 2 * normal_upper("z"))
    p = F.coalesce(_exact_p("_u_exact", "n_1", "n_2"), normal)
    out = base.withColumn("p_value", p).drop("_u_exact")
    effect = F.abs(normal_quantile(F.col("p_value") / 2)) / F.sqrt(F.col("n_1") + F.col("n_2"))
    return (out.withColumn("effect_r", effect).withColumn("significance", stars(F.col("p_value")))
            .withColumn("p_display", p_text(F.col("p_value"))))


@plain_names("value", "group", "by")
def kruskal(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    """Tie-corrected H, its chi-square p and the eta squared of H."""
    by = list(by)
    num = numeric(df, [value]).where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranked = average_ranks(num.withColumnRenamed(group, "grp"), value, by, ["grp"])
    tie = F.col("tie").cast("double")
    per = ranked.groupBy(*by, "grp").agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("rank")).alias("rank_sum"),
        F.sum(F.col("n") / tie * (tie * tie * tie - tie)).alias("ties"))
    agg = per.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("ties").alias("ties"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_s"))
    n = F.col("n")
    raw = 12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1)
    h = F.try_divide(raw, 1 - F.try_divide(F.col("ties"), n * n * n - n))
    out = (agg.withColumn("h_statistic", h).withColumn("df", F.col("k") - 1)
           .withColumn("p_value", chi2_upper("h_statistic", F.col("df").cast("double"))))
    eta = F.greatest(F.try_divide(F.col("h_statistic") - F.col("k") + 1, n - F.col("k")), F.lit(0.0))
    return (out.withColumn("eta_squared_h", eta).withColumn("significance", stars(F.col("p_value")))
            .withColumn("p_display", p_text(F.col("p_value"))).withColumn("n", n.cast("long")).drop("_s", "ties"))


@plain_names("items", "by")
def reliability(df: DataFrame, items: list[str], by: list[str] = ()) -> DataFrame:
    """Cronbach's alpha over complete rows, item variances from one aggregate."""
    by = list(by)
    sub = numeric(df, items).dropna(subset=items)
    total = sum((F.col(c) for c in items[1:]), F.col(items[0]))
    agg = sub.groupBy(*by).agg(F.count("*").alias("n"), F.var_samp(total).alias("_total"),
                               sum((F.var_samp(c) for c in items[1:]), F.var_samp(items[0])).alias("_items"))
    k = len(items)
    problem = (F.when((F.col("n") < 2) | F.lit(k < 2), "Reliability analysis needs at least 2 items and 2 valid rows.")
               .when(F.col("_total") == 0, "Total variance is zero, alpha is undefined."))
    alpha = F.lit(k / (k - 1) if k > 1 else None).cast("double") * (1 - F.try_divide(F.col("_items"), F.col("_total")))
    out = agg.select(*by, "n", F.lit(k).alias("n_items"), F.when(problem.isNull(), alpha).alias("alpha"),
                     problem.alias("error"))
    return out.withColumn("effect_size", effect_label("alpha", F.col("alpha")))


@plain_names("items", "by", told=("item",))
def item_totals(df: DataFrame, items: list[str], by: list[str] = ()) -> DataFrame:
    """Variance of each item and its correlation with the sum of the others."""
    by = list(by)
    sub = numeric(df, items).dropna(subset=items)

    def rest(c):
        others = [F.col(x) for x in items if x != c]
        return sum(others[1:], others[0])

    rows = F.array(*[F.struct(F.lit(c).alias("item"), r4(F.var_samp(c)).alias("item_variance"),
                              r4(F.corr(F.col(c), rest(c))).alias("item_total_correlation")) for c in items])
    return sub.groupBy(*by).agg(rows.alias("_r")).select(*by, F.inline("_r"))
