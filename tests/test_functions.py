import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.functions import parsing, scalars, special
from statloom.operators.normality import shapiro_wilk
from statloom.plans.cleaning import sanitise_names, standard_names

NUMBERS = [
    ("12", 12.0), (" 12.5 ", 12.5), ("1.234", 1.234), ("1e3", 1000.0), ("+.5", 0.5), ("-7", -7.0), ("5.", 5.0),
    ("$1,863.84", 1863.84), ("1.863,84", 1863.84), ("€ 1863,84", 1863.84), ("£-5", -5.0), ("₦1,234,567", 1234567.0),
    ("1,234", 1234.0), ("1,23", 1.23), ("1 234", 1234.0), ("1 234,5", None), ("1.234.567", 1234567.0),
    ("1,234,567.8", 1234567.8), ("12.34.56", 123456.0), ("1 234.567", 1234567.0), ("1 234", 1234.0),
    ("1_000", 1000.0), ("N/A", None), ("-", None), ("", None), ("12%", None), ("(5)", None), ("1d", None), ("1.5f", None),
    ("abc", None), ("$", None), ("1,2,3.4,5", None), ("nan", None), ("-inf", -math.inf), (None, None), ("0x10", None),
]
DATES = [
    ("Jan 5, 2024", "2024-01-05"), ("March 15, 2024", "2024-03-15"), ("05/03/2024 10:30", "2024-05-03"), ("25/03/2024 10:30", "2024-03-25"),
    ("2024/3/5 1:02:03", "2024-03-05"),
    ("2024-01-05", "2024-01-05"), ("2024-1-5", "2024-01-05"), ("05/01/2024", "2024-01-05"), ("1/2/2024", "2024-02-01"),
    ("12/31/2024", "2024-12-31"), ("5-1-2024", "2024-01-05"), ("2024/1/5", "2024-01-05"), ("Jan 5 2024", "2024-01-05"),
    ("jan  5 2024", "2024-01-05"), ("January 5 2024", "2024-01-05"), ("5 Jan 2024", "2024-01-05"),
    ("5 JANUARY 2024", "2024-01-05"), ("20240105", "2024-01-05"), ("2024-01-05T10:30:00", "2024-01-05"),
    ("2024-01-05 23:59:59", "2024-01-05"), ("2024-02-30", None), ("31/31/2024", None), ("hello", None), ("", None),
    ("10:30", None), (None, None), ("1863.84", None),
]


def column(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("s"))).collect()]


def test_numbers(spark):
    got = column(spark, [n for n, _ in NUMBERS], parsing.parse_number)
    assert list(zip([n for n, _ in NUMBERS], got)) == NUMBERS


def test_dates(spark):
    got = column(spark, [d for d, _ in DATES], lambda c: parsing.parse_date(c).cast("string"))
    assert list(zip([d for d, _ in DATES], got)) == DATES


def test_cells(spark):
    assert column(spark, [" a ", "nan", " x\t", "N/A", "?", ".", "ok", "None"], parsing.clean_cell) == [
        "a", None, "x", None, None, None, "ok", None]
    assert column(spark, ["FULL-TIME", "don't", "élan vital", "a1b"], parsing.title_case) == [
        "Full-Time", "Don'T", "Élan Vital", "A1B"]
    assert column(spark, ["=1", "+a", "-a", "@x", "a=b", None], scalars.guard_formula) == [
        "'=1", "'+a", "'-a", "'@x", "a=b", None]
    assert column(spark, ["**a** and **b**", "x\n**y**", "**"], scalars.strip_markdown) == ["a and b", "x\ny", "**"]


def test_labels_on_both_sides_of_each_cut(spark):
    df = spark.createDataFrame([(v,) for v in (0.0009, 0.001, 0.0099, 0.01, 0.049, 0.05)], "p double")
    assert [r[0] for r in df.select(scalars.stars(F.col("p"))).collect()] == ["***", "**", "**", "*", "*", "ns"]
    assert [r[0] for r in df.select(scalars.p_text(F.col("p"))).collect()][:2] == ["p < .001", "p = 0.001"]
    cases = {"cramers_v": [(0.09, "negligible"), (0.1, "small"), (0.3, "moderate"), (0.5, "large")],
             "cohens_d": [(-0.19, "negligible"), (-0.2, "small"), (0.5, "medium"), (-0.8, "large")],
             "eta_squared": [(0.05, "small"), (0.06, "medium"), (0.14, "large")],
             "correlation": [(0.09, "negligible"), (-0.1, "weak"), (0.3, "moderate"), (0.5, "strong"), (-0.7, "very strong")],
             "alpha": [(-0.95, "unacceptable"), (0.5, "poor"), (0.6, "questionable"), (0.7, "acceptable"), (0.8, "good"),
                       (0.9, "excellent")]}
    for kind, pairs in cases.items():
        df = spark.createDataFrame([(v,) for v, _ in pairs], "v double")
        assert [r[0] for r in df.select(scalars.effect_label(kind, F.col("v"))).collect()] == [n for _, n in pairs]


def test_prices(spark):
    df = spark.createDataFrame([(1.0, "NGN", 1530.0, "₦"), (2.5, "GBP", 1.98, "£"), (3.0, "USD", 3.0, "$"),
                                (2.5, "USD", 2.5, "$"), (1200.0, "XXX", 1200.0, None)],
                               "usd double, cur string, conv double, sym string")
    got = [r[0] for r in df.select(scalars.format_price(F.col("usd"), F.col("cur"), F.col("conv"), F.col("sym"))).collect()]
    assert got == ["₦1,530 (~$1)", "£1.98 (~$2.50)", "$3", "$2.5", "XXX 1,200.00 (~$1200)"]


def test_names():
    assert sanitise_names([" a b ", "1x", "", "x!", "x", "X"]) == ["a_b", "col_1x", "col_3", "x", "x_2", "X_3"]
    assert standard_names(["sex", "student_id", "region", "total_salary", "gender", "n", "notes"]) == [
        "Gender", "student_id", "region", "Total", "Gender_2", "Count", "notes"]


def test_tails_against_commons_math(spark):
    dist = spark._jvm.org.apache.commons.math3.distribution
    for df in (1.0, 2.5, 7.0, 30.0, 500.0, 59998.0):
        law = dist.TDistribution(df)
        for t in (0.0, 0.3, 1.96, 4.0, 12.0):
            assert float(special.t_sf(t, df)) == pytest.approx(law.cumulativeProbability(-t), rel=1e-8, abs=1e-14)
        for p in (0.6, 0.9, 0.975, 0.999):
            assert float(special.t_ppf(p, df)) == pytest.approx(law.inverseCumulativeProbability(p), rel=1e-6)
    for d1, d2 in ((1, 5), (2, 30), (4, 1495), (7, 59990)):
        law = dist.FDistribution(float(d1), float(d2))
        for f in (0.1, 1.0, 2.5, 9.0):
            assert float(special.f_sf(f, d1, d2)) == pytest.approx(1 - law.cumulativeProbability(f), rel=1e-6, abs=1e-12)
    for k in (1, 2, 5, 40):
        law = dist.ChiSquaredDistribution(float(k))
        for x in (0.01, 1.0, 5.0, 60.0):
            assert float(special.chi2_sf(x, k)) == pytest.approx(1 - law.cumulativeProbability(x), rel=1e-6, abs=1e-12)
    law = dist.NormalDistribution()
    p = np.array([1e-5, 0.02425, 0.3, 0.5, 0.9, 0.999999])
    assert special.norm_ppf(p) == pytest.approx([law.inverseCumulativeProbability(float(x)) for x in p], abs=1e-9)


def test_tails_limits():
    assert float(special.norm_ppf(np.array([1e-12]))[0]) == pytest.approx(-7.0344838253, abs=1e-9)
    assert float(special.f_sf(np.inf, 3, 10)) == 0.0
    assert float(special.t_sf(1.959963984540054, 1e12)) == pytest.approx(0.025, abs=1e-9)
    assert float(special.f_sf(2.0, 4, 1e12)) == pytest.approx(float(special.f_sf(2.0, 4, 9e7)), abs=1e-6)
    assert np.isnan(special.t_sf(1.0, 0.0))


def test_shapiro_published_example():
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert (round(w, 4), round(p, 4)) == (0.7888, 0.0067)


def test_shapiro_shapes():
    normal = special.norm_ppf((np.arange(1, 1001) - 0.5) / 1000)
    w, p = shapiro_wilk(normal)
    assert w > 0.999 and p > 0.9
    w, p = shapiro_wilk(np.exp(normal))
    assert p < 1e-20
    assert shapiro_wilk(np.ones(10)) == (1.0, 1.0)
    assert math.isnan(shapiro_wilk(np.array([1.0, 2.0]))[0])
    assert shapiro_wilk(np.array([1.0, 2.0, 3.0]))[0] == pytest.approx(1.0)
