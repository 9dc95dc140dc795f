import itertools
import math
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statloom.functions import special
from statloom.operators import (accounts, assumptions, chartdata, comparisons, correlation, crosstab, dedup, ledger, normality,
                                outliers, profile, ranks, regression, summaries)
from statloom.operators.bucketing import bucket_of, cut_points
from statloom.operators.prefix import running_sum


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def skewed_rows(n=4000, seed=5):
    """A third of the rows hold one value, and a third belong to one group."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = 7.0 if rng.random() < 0.34 else round(rng.expovariate(0.1), 2)
        g = "hot" if rng.random() < 0.34 else f"g{rng.randrange(5)}"
        rows.append((i, x, g))
    return rows


@pytest.fixture(scope="module")
def skewed(spark):
    return frame(spark, skewed_rows(), "id long, x double, g string").repartition(7).cache()


# --- ranks and quantiles ------------------------------------------------------------

@pytest.mark.parametrize("partitions", [1, 4, 37])
def test_ranks_do_not_depend_on_path_or_partitions(spark, skewed, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        want = pd.DataFrame(skewed_rows(), columns=["id", "x", "g"])["x"]
        expected = dict(zip(want, want.rank()))
        got = {r["x"]: r["rank"] for r in ranks.average_ranks(skewed, "x").collect()}
        assert got == expected
        by = ranks.average_ranks(skewed, "x", ["g"]).agg(F.sum(F.col("n") * F.col("rank"))).first()[0]
        sizes = [r["count"] for r in skewed.groupBy("g").count().collect()]
        assert by == sum(n * (n + 1) / 2 for n in sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_buckets_are_monotone_and_balanced(spark):
    df = spark.range(5000).select((F.col("id") % 977 + F.rand(3) * 0).alias("k"))
    cuts = cut_points(df, "k", 16)
    out = df.select("k", bucket_of(F.col("k"), cuts).alias("b")).toPandas().sort_values("k")
    assert out["b"].is_monotonic_increasing and out["b"].nunique() >= 15
    assert df.select(bucket_of(F.col("k"), [])).distinct().collect() == [(0,)]


def test_quantile_paths_agree(spark, skewed, monkeypatch):
    probs = [0.0, 0.1, 0.25, 0.5, 0.6667, 0.75, 1.0]
    x = np.array([r[1] for r in skewed_rows()])
    want = np.quantile(x, probs)
    got = {}
    got["narrow"] = ranks.quantiles(skewed, ["x"], probs).first()["q"]
    monkeypatch.setattr(ranks, "NARROW_ROWS", 20)
    got["rounds"] = ranks.quantiles(skewed, ["x"], probs).first()["q"]
    for q in got.values():
        assert q == pytest.approx(list(want))


def test_segment_quantiles_agree(skewed):
    probs = [0.25, 0.5, 0.9]
    got = {r["g"]: r["q"] for r in ranks.quantiles(skewed, ["x"], probs, ["g"]).collect()}
    pdf = pd.DataFrame(skewed_rows(), columns=["id", "x", "g"])
    assert set(got) == set(pdf["g"])
    for g, part in pdf.groupby("g"):
        assert got[g] == pytest.approx(list(np.quantile(part["x"], probs)))


def test_quantiles_of_odd_columns(spark):
    df = frame(spark, [(1, None, 2.0), (2, None, 2.0), (3, None, 2.0)], "id long, e double, c double")
    got = {r["variable"]: r["q"] for r in ranks.quantiles(df, ["e", "c"], [0.25, 0.5]).collect()}
    assert got["c"] == [2.0, 2.0] and not [x for x in got.get("e") or [] if x is not None]


def test_narrowing_recovers_from_bad_sketch(spark, monkeypatch):
    """A misleading grid must be rejected by the counts, never trusted."""
    df = spark.range(2000).select(F.col("id").cast("double").alias("x"))
    real = ranks._Target.proposal
    calls = []

    def wrong(self):
        calls.append(1)
        return (self.low, self.low) if len(calls) == 1 else real(self)

    monkeypatch.setattr(ranks._Target, "proposal", wrong)
    assert ranks.quantiles(df, ["x"], [0.5]).first()["q"] == [999.5]


# --- tests ------------------------------------------------------------------------

def test_t_test_by_hand(spark):
    a, b = [1.0, 2.0, 3.0, 4.0], [2.0, 4.0, 6.0, 8.0, 10.0]
    df = frame(spark, [("a", x) for x in a] + [("b", x) for x in b] + [("a", None), (None, 3.0)], "g string, x double")
    r = comparisons.t_test(df, "x", "g").first()
    v1, v2 = np.var(a, ddof=1), np.var(b, ddof=1)
    sp2 = (3 * v1 + 4 * v2) / 7
    assert r["t_pooled"] == pytest.approx(-3.5 / math.sqrt(sp2 * (1 / 4 + 1 / 5)))
    assert r["cohens_d"] == pytest.approx(-3.5 / math.sqrt(sp2))
    se = math.sqrt(v1 / 4 + v2 / 5)
    dfw = se**4 / ((v1 / 4) ** 2 / 3 + (v2 / 5) ** 2 / 4)
    assert (r["t_welch"], r["df_welch"]) == (pytest.approx(-3.5 / se), pytest.approx(dfw))
    half = float(special.t_ppf(0.975, dfw)) * se
    assert (r["ci_low"], r["ci_high"]) == (pytest.approx(-3.5 - half), pytest.approx(-3.5 + half))


def test_t_test_edges(spark):
    three = frame(spark, [("a", 1.0), ("b", 2.0), ("c", 3.0)], "g string, x double")
    assert "found 3" in comparisons.t_test(three, "x", "g").first()["error"]
    flat = frame(spark, [("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, x double")
    r = comparisons.t_test(flat, "x", "g").first()
    assert r["cohens_d"] == 0.0 and r["t_pooled"] is None
    single = frame(spark, [("a", 1.0), ("b", 2.0)], "g string, x double")
    assert comparisons.t_test(single, "x", "g").first()["p_pooled"] is None


def test_text_and_nan_are_missing(spark):
    df = frame(spark, [("a", "1"), ("a", "x"), ("a", "3"), ("b", "4"), ("b", "NaN"), ("b", "6")], "g string, x string")
    r = comparisons.t_test(df, "x", "g").first()
    assert (r["n_1"], r["n_2"]) == (2, 2)
    nan = frame(spark, [("a", 1.0), ("a", float("nan")), ("b", 2.0), ("b", None)], "g string, x double")
    assert [r["n"] for r in summaries.group_summary(nan, "x", "g").orderBy("grp").collect()] == [1, 1]


def test_anova_decomposition(spark, skewed):
    r = comparisons.anova(skewed, "x", "g").first()
    x = np.array([row[1] for row in skewed_rows()])
    assert r["ss_between"] + r["ss_within"] == pytest.approx(((x - x.mean()) ** 2).sum())
    pairs = comparisons.pairwise_t(skewed, "x", "g")
    assert pairs.count() == 15 and pairs.where("group_1 >= group_2").count() == 0
    two = skewed.where("g IN ('g0', 'g1')")
    t, f = comparisons.t_test(two, "x", "g").first(), comparisons.anova(two, "x", "g").first()
    assert f["f_statistic"] == pytest.approx(t["t_pooled"] ** 2)
    assert f["p_value"] == pytest.approx(t["p_pooled"])


def brute_u(a, b):
    """Share of all regroupings at least as far from the middle."""
    def u(first, second):
        return sum((x > y) + 0.5 * (x == y) for x in first for y in second)

    every, n = a + b, len(a)
    mid, seen, far = n * len(b) / 2, 0, 0
    goal = abs(u(a, b) - mid)
    for pick in itertools.combinations(range(len(every)), n):
        first = [every[i] for i in pick]
        second = [every[i] for i in range(len(every)) if i not in pick]
        seen += 1
        far += abs(u(first, second) - mid) >= goal - 1e-9
    return u(a, b), far / seen


def test_mann_whitney_exact(spark):
    a, b = [1.1, 5.2, 3.3, 9.4, 2.5], [4.0, 8.0, 7.0, 10.0, 11.0, 6.0, 12.0]
    df = frame(spark, [("a", x) for x in a] + [("b", x) for x in b], "g string, x double")
    u, p = brute_u(a, b)
    r = comparisons.mann_whitney(df, "x", "g").first()
    assert (r["u_statistic"], r["p_value"]) == (u, pytest.approx(p))


def test_mann_whitney_ties_and_symmetry(spark, skewed):
    two = skewed.where("g IN ('hot', 'g1')")
    r = comparisons.mann_whitney(two, "x", "g").first()
    turned = two.withColumn("g", F.when(F.col("g") == "hot", "a").otherwise("z"))
    s = comparisons.mann_whitney(turned, "x", "g").first()
    assert r["u_statistic"] + s["u_statistic"] == r["n_1"] * r["n_2"]
    assert r["p_value"] == pytest.approx(s["p_value"])
    assert comparisons.mann_whitney(skewed, "x", "g").first()["error"]


def test_kruskal_against_pandas(skewed):
    pdf = pd.DataFrame(skewed_rows(), columns=["id", "x", "g"])
    rank, n = pdf["x"].rank(), len(pdf)
    h = 12 / (n * (n + 1)) * (rank.groupby(pdf["g"]).sum() ** 2 / pdf.groupby("g").size()).sum() - 3 * (n + 1)
    ties = pdf["x"].value_counts()
    r = comparisons.kruskal(skewed, "x", "g").first()
    assert r["h_statistic"] == pytest.approx(h / (1 - (ties**3 - ties).sum() / (n**3 - n)))
    assert r["df"] == 5


def test_levene_against_pandas(spark, skewed):
    pdf = pd.DataFrame(skewed_rows(), columns=["id", "x", "g"])
    z = (pdf["x"] - pdf.groupby("g")["x"].transform("median")).abs()
    means, sizes = z.groupby(pdf["g"]).mean(), pdf.groupby("g").size()
    k, n = len(sizes), len(z)
    between = (sizes * (means - z.mean()) ** 2).sum() / (k - 1)
    within = ((z - z.groupby(pdf["g"]).transform("mean")) ** 2).sum() / (n - k)
    r = comparisons.levene(skewed, "x", "g").first()
    assert r["levene_f"] == pytest.approx(between / within) and r["n"] == 4000
    single = frame(spark, [("a", 1.0), ("b", 2.0), ("b", 3.0)], "g string, x double")
    assert comparisons.levene(single, "x", "g").first()["levene_p"] is None


def test_reliability(spark):
    rows = [(1, 2, 3), (2, 3, 4), (4, 4, 5), (5, 5, 5), (None, 1, 1)]
    df = frame(spark, rows, "a int, b int, c int")
    m = np.array(rows[:4], dtype=float)
    alpha = 1.5 * (1 - m.var(axis=0, ddof=1).sum() / m.sum(axis=1).var(ddof=1))
    r = comparisons.reliability(df, ["a", "b", "c"]).first()
    assert (r["n"], r["alpha"]) == (4, pytest.approx(alpha))
    items = {x["item"]: x["item_total_correlation"] for x in comparisons.item_totals(df, ["a", "b", "c"]).collect()}
    assert items["a"] == pytest.approx(np.corrcoef(m[:, 0], m[:, 1] + m[:, 2])[0, 1], abs=1e-4)
    flat = frame(spark, [(1, 1), (1, 1)], "a int, b int")
    assert "zero" in comparisons.reliability(flat, ["a", "b"]).first()["error"]
    assert "at least 2" in comparisons.reliability(df.limit(1), ["a", "b"]).first()["error"]


# --- crosstab -----------------------------------------------------------------------

def chi2(table, yates=False):
    o = np.array(table, dtype=float)
    e = o.sum(1, keepdims=True) * o.sum(0, keepdims=True) / o.sum()
    gap = np.abs(o - e)
    return ((gap - (np.minimum(0.5, gap) if yates else 0)) ** 2 / e).sum()


def test_chi_square_with_absent_cells(spark):
    table = [[5, 0, 9], [3, 8, 0]]
    rows = [(f"r{i}", f"c{j}") for i, r in enumerate(table) for j, n in enumerate(r) for _ in range(n)]
    df = frame(spark, rows + [(None, "c1"), ("r0", None)], "a string, b string")
    r = crosstab.chi_square(df, "a", "b").first()
    assert (r["chi2"], r["dof"], r["n"]) == (pytest.approx(chi2(table)), 2, 25)
    cells = crosstab.residuals(df, "a", "b")
    assert cells.count() == 6 and cells.where("n = 0").count() == 2
    assert cells.agg(F.sum("expected")).first()[0] == pytest.approx(25)


def test_chi_square_two_by_two(spark):
    for table in ([[12, 5], [3, 9]], [[7, 0], [2, 6]], [[5, 5], [5, 5]]):
        rows = [(i, j) for i, r in enumerate(table) for j, n in enumerate(r) for _ in range(n)]
        r = crosstab.chi_square(frame(spark, rows, "a int, b int"), "a", "b").first()
        assert r["chi2"] == pytest.approx(chi2(table, True), abs=1e-12) and r["dof"] == 1
        assert r["chi2"] <= chi2(table) + 1e-12
    flat = frame(spark, [(1, 1), (1, 2)], "a int, b int")
    assert crosstab.chi_square(flat, "a", "b").first()["p_value"] == 1.0


# --- correlation, regression ----------------------------------------------------------

def test_spearman_against_pandas(spark, skewed):
    df = skewed.withColumn("y", F.col("x") * F.col("x") + F.col("id") % 50).withColumn("z", (F.col("id") % 3).cast("double"))
    pdf = df.select("x", "y", "z").toPandas()
    want = pdf.rank().corr()
    for r in correlation.spearman(df, ["x", "y", "z"]).collect():
        assert r["r"] == pytest.approx(want.loc[r["variable_1"], r["variable_2"]], abs=1e-12)
        assert r["n"] == 4000


def test_perfect_correlation(spark):
    df = spark.range(10).select(F.col("id").alias("a"), (-F.col("id")).alias("b"))
    r = correlation.pearson(df, ["a", "b"]).first()
    assert (r["r"], r["p_value"], r["strength"]) == (pytest.approx(-1), 0.0, "negative very strong")


def test_regression_against_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) + 100
    y = 3 + x @ [1.5, -2.0, 0.25] + rng.normal(size=200)
    df = spark.createDataFrame(pd.DataFrame(np.column_stack([y, x]), columns=["y", "a", "b", "c"]))
    design = np.column_stack([np.ones(200), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    resid = y - design @ beta
    mse = (resid**2).sum() / 196
    se = np.sqrt(mse * np.diag(np.linalg.inv(design.T @ design)))
    rows = regression.coefficients(df, "y", ["a", "b", "c"]).orderBy("position").collect()
    assert [r["b"] for r in rows] == pytest.approx(list(beta))
    assert [r["std_error"] for r in rows] == pytest.approx(list(se), rel=1e-5)
    got = regression.residual_rows(df, "y", ["a", "b", "c"]).agg(F.sum(F.col("residual") * F.col("residual"))).first()[0]
    assert got == pytest.approx((resid**2).sum())


def test_regression_edges(spark):
    same = spark.range(20).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"),
                                  (F.col("id") * 3.0 + F.col("id") % 2).alias("y"))
    rows = regression.coefficients(same, "y", ["a", "b"]).orderBy("position").collect()
    assert rows[1]["b"] * 1 + rows[2]["b"] * 2 == pytest.approx(3.0, abs=0.01)
    assert regression.coefficients(same.limit(2), "y", ["a", "b"]).count() == 0


# --- descriptives and charts --------------------------------------------------------------

def test_describe_against_pandas(spark, skewed):
    pdf = pd.DataFrame(skewed_rows(), columns=["id", "x", "g"])
    r = summaries.describe(skewed, ["x"], normality=True).first()
    assert r["skewness"] == pytest.approx(pdf["x"].skew(), abs=1e-4)
    assert r["kurtosis"] == pytest.approx(pdf["x"].kurt(), abs=1e-4)
    assert (r["median"], r["q1"], r["q3"]) == tuple(pytest.approx(v, abs=1e-4) for v in pdf["x"].quantile([0.5, 0.25, 0.75]))
    assert r["std_dev"] == pytest.approx(pdf["x"].std(), abs=1e-4)
    assert r["normality_p"] == r["shapiro_p"] == 0.0


def test_describe_counts_missing_once(spark):
    df = frame(spark, [("1",), (None,), ("N/A",), ("",), ("x",), ("2",)], "v string")
    r = summaries.describe(df, ["v"]).first()
    assert (r["n"], r["missing"]) == (2, 3)
    assert summaries.describe(df.where("v = 'x'"), ["v"]).count() == 0


def test_histogram_counts_every_row(spark, skewed):
    bins = chartdata.histogram(skewed, "x").collect()
    x = np.array([r[1] for r in skewed_rows()])
    counts, edges = np.histogram(x, bins="auto")
    assert sum(b["n"] for b in bins) == 4000
    assert len(bins) == len(counts)
    flat = frame(spark, [(2.0,), (2.0,)], "x double")
    assert [b["n"] for b in chartdata.histogram(flat, "x").collect()] == [2]


def test_box_plot_against_pandas(skewed):
    pdf = pd.DataFrame(skewed_rows(), columns=["id", "x", "g"])
    boxes = {r["grp"]: r for r in chartdata.box_plot(skewed, "x", "g").collect()}
    for g, part in pdf.groupby("g"):
        q1, q3 = part["x"].quantile([0.25, 0.75])
        inside = part["x"].between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
        r = boxes[g]
        assert (r["q1"], r["q3"], r["whisker_low"], r["whisker_high"]) == pytest.approx(
            (q1, q3, part["x"][inside].min(), part["x"][inside].max()))
        assert r["fliers"] == (~inside).sum()
    assert chartdata.box_fliers(skewed, "x", "g", ["id"]).count() == sum(r["fliers"] for r in boxes.values())


def test_histogram_with_a_far_value(spark, monkeypatch):
    monkeypatch.setattr(chartdata, "RUN", 16)
    df = spark.range(2000).select(F.when(F.col("id") == 0, 5000.0).otherwise(F.col("id") % 10 / 10).alias("x"))
    bins = chartdata.histogram(df, "x").orderBy("bin").collect()
    assert len(bins) > 1000 and [b["bin"] for b in bins] == list(range(len(bins))) and sum(b["n"] for b in bins) == 2000


def test_scatter_counts_every_row(spark, skewed):
    cells = chartdata.scatter_cells(skewed.withColumn("y", F.col("id") % 17), "x", "y", 20).collect()
    assert sum(c["n"] for c in cells) == 4000 and all(0 <= c["x_cell"] < 20 and 0 <= c["y_cell"] < 20 for c in cells)


def test_density_integrates_to_one(skewed):
    pts = chartdata.density(skewed.where("g <> 'g1'"), "x").orderBy("x").collect()
    area = np.trapezoid([p["density"] for p in pts], [p["x"] for p in pts])
    assert 0.85 < area < 1.02


def test_qq_points(spark):
    df = spark.range(5).select((F.col("id") * 10.0).alias("x"))
    pts = chartdata.qq_points(df, "x").orderBy("position").collect()
    assert [p["observed"] for p in pts] == [0.0, 10.0, 20.0, 30.0, 40.0]
    assert pts[2]["theoretical"] == pytest.approx(0, abs=1e-12)
    assert pts[4]["theoretical"] == pytest.approx(float(special.norm_ppf(np.array([0.5 ** 0.2]))[0]))
    many = spark.range(2500).select((F.col("id") % 7).cast("double").alias("x"))
    pts = chartdata.qq_points(many, "x")
    assert pts.count() == 2500 and pts.agg(F.countDistinct("position")).first()[0] == 2500


def test_shapiro_of_whole_variables(spark, skewed):
    pdf = pd.DataFrame(skewed_rows(), columns=["id", "x", "g"])
    got = {r["g"]: r for r in normality.shapiro_table(skewed, ["x"], ["g"]).collect()}
    for g, part in pdf.groupby("g"):
        w, p = normality.shapiro_wilk(part["x"].to_numpy())
        assert (got[g]["n"], got[g]["w"], got[g]["p"]) == (len(part), pytest.approx(w), pytest.approx(p))
    rng = np.random.default_rng(3)
    samples = {"tiny": [1.0, 2.0], "three": [1.0, 2.0, 4.0], "five": [3.0, 1.0, 2.0, 7.0, 5.0], "eleven": [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], "flat": [2.0] * 40,
               "normal": rng.normal(10, 3, 5000), "ties": np.round(rng.normal(0, 2, 4999)), "runs": rng.integers(0, 3, 3000).astype(float), "skew": rng.exponential(1, 700),
               "far": np.r_[rng.normal(0, 1, 300), 1e9], "edge": rng.normal(0, 1, 129), "middle": np.r_[np.zeros(1000), rng.normal(0, 1, 200)]}
    rows = pa.table({"g": [g for g, v in samples.items() for _ in v], "x": [float(x) for v in samples.values() for x in v]})
    got = {r["g"]: r for r in normality.shapiro_table(spark.createDataFrame(rows), ["x"], ["g"]).collect()}
    for g, values in samples.items():
        w, p = normality.shapiro_wilk(np.array(values))
        if len(values) < 3:
            assert got[g]["w"] is None and got[g]["p"] is None
        else:
            assert (got[g]["w"], got[g]["p"]) == (pytest.approx(w, abs=1e-6), pytest.approx(p, abs=1e-5)), g


def test_shapiro_beyond_its_published_range():
    """The same sums one rank at a time, for 20,000 values with and without ties."""
    rng = np.random.default_rng(5)
    for values in (rng.normal(0, 1, 20_000), np.round(rng.normal(0, 3, 20_001))):
        w, p = normality.shapiro_wilk(values)
        x, n = np.sort(values) - values.mean(), len(values)
        found, counts = np.unique(x, return_counts=True)
        below = np.cumsum(counts) - counts
        scores = normality.score_sums(below.astype(float), counts.astype(float), np.full(len(found), float(n)))
        got = normality.w_and_p(n, float((found * scores).sum()), float((x * x).sum()), (x[0], x[1], x[-2], x[-1]))
        assert got == (pytest.approx(w, abs=1e-8), pytest.approx(p, abs=1e-4))


def test_normality_is_judged_on_every_row(spark):
    """The first 6,000 values are even; what follows is not."""
    df = spark.range(20_000).select(F.when(F.col("id") < 6000, F.col("id") % 100).otherwise(F.col("id") * F.col("id")).cast("double").alias("x"))
    assert not assumptions.normality_check(df, "t_test", "x").first()["passed"]
    flat = spark.range(50).select(F.lit(1.0).alias("x"))
    assert assumptions.normality_check(flat, "t_test", "x").first()["passed"]


def test_crosstab_with_a_near_unique_level(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("a"), F.col("id").alias("b"))
    r = crosstab.chi_square(df, "a", "b").first()
    assert r["chi2"] == pytest.approx(3000) and r["dof"] == 2999
    assert crosstab.residuals(df, "a", "b").count() == 6000
    shares = crosstab.row_percents(df, "a", "b")
    assert shares.agg(F.round(F.sum("percent"), 6)).first()[0] == 200.0


def test_pairwise_t_has_every_pair_once(spark):
    df = spark.range(400).select((F.col("id") % 20).alias("g"), (F.col("id") * 7 % 31).cast("double").alias("x"), (F.col("id") % 2).alias("s"))
    assert comparisons.pairwise_t(df, "x", "g").count() == 190
    by = comparisons.pairwise_t(df, "x", "g", ["s"])
    assert by.count() == 90 and by.select("pairs").distinct().collect() == [(45,)]


# --- profile, duplicates, outliers -----------------------------------------------------------

def test_semantic_types(spark):
    rows = [(i, "yes" if i % 2 else "no", str(i % 5 + 1), f"${i}.50", f"2024-01-{i % 28 + 1:02d}", f"text {i}", "A" if i % 3 else "B",
             None, str(i), "only") for i in range(120)]
    df = frame(spark, rows, "_row_id long, flag string, likert string, price string, day string, free string, cat string, "
                            "blank string, user_id string, one string")
    cols = df.columns[1:]
    want = {"flag": "boolean", "likert": "ordinal", "price": "numeric", "day": "date", "free": "text", "cat": "categorical",
            "blank": "empty", "user_id": "identifier", "one": "categorical"}
    exact = profile.semantic_type(profile.profile(profile.value_counts(df, cols, "_row_id")))
    assert {r["variable"]: r["type"] for r in exact.collect()} == want
    sketch = profile.semantic_type(profile.fast_profile(df, cols, "_row_id"))
    assert {r["variable"]: r["type"] for r in sketch.collect()} == want


def test_mixed_samples_keep_row_order(spark):
    rows = [(i, v) for i, v in enumerate(["1", "zeta", "2", "alpha", "zeta", "x1", "x2", "x3", "x4", None])]
    df = frame(spark, rows, "_row_id long, v string")
    r = profile.mixed_columns(profile.value_counts(df, ["v"], "_row_id")).first()
    assert (r["numeric_cells"], r["filled"], r["samples"]) == (2, 9, "zeta, alpha, x1, x2, x3")


def test_duplicates(spark):
    rows = [(1, "a", None, float("nan")), (2, "a", None, float("nan")), (3, "b", 1, 1.0), (4, None, None, None), (5, None, None, None),
            (6, "c", 2, 2.0)]
    df = frame(spark, rows, "_row_id long, s string, i int, d double")
    cols = ["s", "i", "d"]
    first = {r["_row_id"] for r in dedup.drop_duplicates(df, cols, "_row_id").collect()}
    last = {r["_row_id"] for r in dedup.drop_duplicates(df, cols, "_row_id", "last").collect()}
    assert (first, last) == ({1, 3, 4, 6}, {2, 3, 5, 6})
    assert dedup.duplicate_count(df, cols).first()["duplicates"] == 2
    flags = {r["_row_id"]: r["_duplicate_flag"] for r in dedup.flag_duplicates(df, cols, "_row_id").collect()}
    assert flags == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}


def test_duplicates_by_value(spark):
    """Instants a microsecond apart differ, zeros of either sign do not; all three operators agree."""
    rows = [(1, "2024-01-01 00:00:00.123456", 0.0), (2, "2024-01-01 00:00:00.123999", 0.0), (3, "2024-01-01 00:00:00.123456", -0.0),
            (4, None, float("nan")), (5, None, float("nan")), (6, None, None)]
    df = frame(spark, rows, "_row_id long, t string, d double").withColumn("t", F.col("t").cast("timestamp")).withColumn(
        "deep", F.struct(F.array("d").alias("a"), "t"))
    for cols in (["t", "d"], ["deep"]):
        flags = {r["_row_id"] for r in dedup.flag_duplicates(df, cols, "_row_id").where("_duplicate_flag").collect()}
        assert flags == {1, 3, 4, 5}
        assert dedup.duplicate_count(df, cols).first()["duplicates"] == 2
        assert dedup.drop_duplicates(df, cols, "_row_id").count() == 4


def test_hot_duplicates_keep_every_row(spark):
    df = spark.range(6000).select(F.col("id").alias("_row_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 2500).cast("string")).alias("s"))
    out = dedup.flag_duplicates(df, ["s"], "_row_id")
    pdf = df.toPandas()
    assert out.count() == 6000
    assert out.where("_duplicate_flag").count() == pdf["s"].duplicated(keep=False).sum()


def test_outliers(spark):
    df = spark.range(40).select("id", F.when(F.col("id") == 7, 1000.0).otherwise(F.col("id") * 1.0).alias("x"), F.lit(3.0).alias("flat"))
    assert [(r["id"], r["variable"]) for r in outliers.outlier_rows(df, ["x", "flat"], "id").collect()] == [(7, "x")]
    assert outliers.outlier_rows(df, ["x"], "id", "zscore").count() == 1
    assert outliers.outlier_rows(df.limit(3), ["x"], "id").count() == 0


def test_imputation(spark):
    df = frame(spark, [(1.0, "b"), (2.0, "a"), (2.0, "a"), (9.0, "b"), (None, None)], "x double, c string")
    for strategy, want in (("median", 2.0), ("mean", 3.5), ("mode", 2.0)):
        r = outliers.impute(df, ["x"], ["c"], strategy).where("x IS NOT NULL").collect()[-1]
        assert (r["x"], r["c"]) == (want, "a")
    assert outliers.impute(df, ["x"], ["c"], "leave").where("x IS NULL").count() == 1
    none = df.select(F.lit(None).cast("double").alias("x"), "c")
    assert outliers.impute(none, ["x"], [], "median").where("x IS NULL").count() == 5


def test_log_transform(spark):
    df = frame(spark, [(-1.0,), (0.0,), (5.0,), (None,)], "x double")
    got = [r["x_log"] for r in outliers.log_transform(df, "x").collect()]
    assert got[:3] == pytest.approx([0.0, math.log(2), math.log(7)]) and got[3] is None
    pos = frame(spark, [(1.0,), (math.e,)], "x double")
    assert [r["x_log"] for r in outliers.log_transform(pos, "x").collect()] == pytest.approx([0.0, 1.0])


# --- ledger ----------------------------------------------------------------------------

def ledger_rows(n=900, seed=2):
    rng = random.Random(seed)
    return [(1 if rng.random() < 0.4 else rng.randrange(2, 30), i, f"2024-01-{rng.randrange(1, 29):02d} 10:{rng.randrange(60):02d}:00",
             rng.choice([5, 20, -8, -15, -3])) for i in range(n)]


@pytest.fixture(scope="module")
def book(spark):
    df = frame(spark, ledger_rows(), "user_id long, event_id long, t string, delta long")
    return df.withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t").cache()


def replay():
    out, balance = {}, {}
    for user, event, ts, delta in sorted(ledger_rows(), key=lambda r: (r[0], r[2], r[1])):
        b = balance.get(user, 0)
        ok = delta >= 0 or b + delta >= 0
        balance[user] = b + delta if ok else b
        out[event] = (balance[user], ok, 0 if ok else -delta - b)
    return out


def test_spend_replay(book):
    want = replay()
    for fn in (ledger.replay_spends, ledger.replay_by_need):
        got = {r["event_id"]: (r["balance"], r["accepted"], r["shortfall"]) for r in fn(book).collect()}
        assert got == want


@pytest.mark.parametrize("bucket", ["minute", "day", "month"])
def test_running_sum_paths(book, bucket):
    want = {}
    total = {}
    for user, event, ts, delta in sorted(ledger_rows(), key=lambda r: (r[0], r[2], r[1])):
        total[user] = total.get(user, 0) + delta
        want[event] = total[user]
    out = running_sum(book, ["user_id"], "ts", ["event_id"], F.col("delta"), "b", bucket)
    assert {r["event_id"]: r["b"] for r in out.collect()} == want


def test_audit_finds_the_tampered_row(book):
    good = ledger.running_balance(book).withColumn("stored", F.col("balance") + F.when(F.col("event_id") == 17, 1).otherwise(0))
    bad = ledger.audit_balances(good.drop("balance"), "stored", "user_id", "ts", ["event_id"], "delta").collect()
    assert [r["event_id"] for r in bad] == [17]


def test_current_state_keeps_older_fields(spark):
    df = frame(spark, [(1, 1, "active", "student"), (1, 2, None, "researcher"), (1, 3, "cancelled", None)],
               "k int, t int, status string, plan string")
    r = ledger.current_state(df, "k", ["t"], ["status", "plan"]).first()
    assert (r["status"], r["plan"]) == ("cancelled", "researcher")


def test_expiry(spark):
    df = frame(spark, [("2024-01-01T00:00:00Z",), ("2024-03-01 00:00:00",), ("soon",), (None,)], "e string")
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert [r[0] for r in df.select(accounts.is_expired(F.col("e"), now)).collect()] == [True, False, False, False]


# --- assumptions --------------------------------------------------------------------------

def test_scores(spark):
    rows = [("t_test", "sample_size", True, "n"), ("t_test", "normality", False, "w"), ("t_test", "outliers", True, "o"),
            ("t_test", "equal_variances", False, "v")]
    checks = frame(spark, rows, "test string, check_id string, passed boolean, name string")
    assert assumptions.score(checks).first()["score"] == 0.5
    r = assumptions.soundness(assumptions.score(checks)).first()
    assert not r["sound"] and "Failed assumptions: v, w." in r["recommendation"]


def test_zero_spread_outlier_check(spark):
    df = frame(spark, [(1.0,)] * 10 + [(2.0,)], "x double")
    assert assumptions.outlier_check(df, "t_test", "x").first()["measure"] == 1.0
