"""Assumption checks as rows (test, check_id, passed, measure, note) and the soundness score built on them."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.functions.scalars import p_text
from statloom.operators import comparisons, correlation, crosstab, outliers, regression
from statloom.operators.naming import col
from statloom.operators.normality import shapiro_table
from statloom.operators.summaries import numeric
from statloom.session import literal_rows

# Display names of the checks.
CHECK_NAMES = {
    "sample_size": "Adequate sample size",
    "normality": "Normality (Shapiro-Wilk)",
    "outliers": "No extreme outliers",
    "equal_variances": "Equal variances (Levene's test)",
    "residual_normality": "Normality of residuals",
    "homoscedasticity": "Homoscedasticity",
    "multicollinearity": "No multicollinearity",
    "expected_counts": "Expected frequencies ≥ 5",
}
# What to do about a failed check, and the automatic fix where there is one.
SUGGESTIONS = {
    "sample_size": "Interpret results with caution for small samples.",
    "normality": "Consider Mann-Whitney U (2 groups) or Kruskal-Wallis (3+ groups) as non-parametric alternatives.",
    "outliers": "Review extreme values and consider whether they are valid data points.",
    "equal_variances": "Welch's t-test is applied automatically when variances are unequal.",
    "residual_normality": "Non-normal residuals suggest the linear model may not be the best fit.",
    "homoscedasticity": "Consider robust standard errors or a data transformation.",
    "multicollinearity": "Remove or combine highly correlated predictors.",
    "expected_counts": "Consider collapsing categories or using Fisher's exact test.",
}
FIXES = {"normality": "log_transform"}


def _check(df: DataFrame, test: str, check: str, passed: Column, measure: Column, note: Column) -> DataFrame:
    return df.select(
        F.lit(test).alias("test"), F.lit(check).alias("check_id"), F.lit(CHECK_NAMES[check]).alias("name"),
        passed.alias("passed"), measure.cast("double").alias("measure"), note.alias("note"),
        F.when(passed, "").otherwise(SUGGESTIONS[check]).alias("suggestion"),
        F.when(~passed, F.lit(FIXES.get(check))).alias("fix"))


def figures_of(df: DataFrame, values: list[str]) -> dict[str, tuple[int, float | None, float | None, int]]:
    """What the checks of single variables need, for all of them together: value -> (n, W, p, cells beyond three-IQR fences).

    One count of distinct values, one narrowing of quartiles and one scan, however many tests ask for a variable; the driver gets a line each.
    """
    num = numeric(df, values)
    tested = {r["variable"]: (r["n"], r["w"], r["p"]) for r in shapiro_table(num, values).collect()}
    quartiles = {r["variable"]: r["q"] for r in outliers.quantiles(num, values, [0.25, 0.75]).collect()}
    far = []
    for i, v in enumerate(values):
        q1, q3 = quartiles[v] or (0.0, 0.0)
        far.append(F.count_if((col(v) < q1 - 3 * (q3 - q1)) | (col(v) > q3 + 3 * (q3 - q1))).alias(f"n{i}"))
    beyond = num.agg(*far).first()
    return {v: (*tested.get(v, (0, None, None)), beyond[i]) for i, v in enumerate(values)}


def sample_size_check(df: DataFrame, test: str, value: str, known: dict | None = None) -> DataFrame:
    if known:
        n = literal_rows(df.sparkSession, [known[value][:1]], "n long")
    else:
        n = numeric(df, [value]).agg(F.count(col(value)).alias("n"))
    ok = F.col("n") >= 30
    note = F.concat(F.format_string("N = %d. ", "n"),
                    F.when(ok, "Sufficient (≥ 30).").otherwise("Small sample — results may be unreliable."))
    return _check(n, test, "sample_size", ok, F.col("n"), note)


def normality_check(df: DataFrame, test: str, value: str, check: str = "normality", known: dict | None = None) -> DataFrame:
    """Shapiro-Wilk on the whole column; no row is left out."""
    sw = literal_rows(df.sparkSession, [known[value][:3]], "n long, w double, p double") if known else shapiro_table(numeric(df, [value]), [value])
    sw = sw.where("n >= 3")
    ok = F.col("p") > 0.05
    if check == "normality":
        tail = F.when(ok, ". Distribution appears normal.").otherwise(". Distribution is not normal.")
        note = F.concat(F.format_string("W = %.3f, ", "w"), p_text(F.col("p")), tail)
    else:
        note = F.concat(F.format_string("Shapiro-Wilk on residuals: W = %.3f, ", "w"), p_text(F.col("p")))
    return _check(sw, test, check, ok, F.col("w"), note)


def outlier_check(df: DataFrame, test: str, value: str, known: dict | None = None) -> DataFrame:
    """Three-IQR fences; a column without spread keeps its closed fence, so any other value counts."""
    if known:
        return _outlier_rows(literal_rows(df.sparkSession, [known[value][3:]], "n long"), test)
    q = outliers.quantiles(numeric(df, [value]), [value], [0.25, 0.75])
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    lim = q.select(F.struct((q1 - 3 * (q3 - q1)).alias("low"), (q3 + 3 * (q3 - q1)).alias("high"))).scalar()
    x = col(value)
    return _outlier_rows(numeric(df, [value]).agg(F.count_if((x < lim["low"]) | (x > lim["high"])).alias("n")), test)


def _outlier_rows(n: DataFrame, test: str) -> DataFrame:
    ok = F.col("n") == 0
    note = F.when(ok, F.lit("No extreme outliers found.")).otherwise(
        F.format_string("%d extreme outlier(s) detected (IQR×3 method).", "n"))
    return _check(n, test, "outliers", ok, F.col("n"), note)


def variance_check(df: DataFrame, test: str, value: str, group: str) -> DataFrame:
    lev = comparisons.levene(df, value, group).where("levene_p IS NOT NULL")
    ok = F.col("levene_p") > 0.05
    tail = F.when(ok, ". Variances are equal.").otherwise(
        ". Unequal variances detected — Welch correction applied automatically.")
    note = F.concat(F.format_string("Levene's F = %.3f, ", "levene_f"), p_text(F.col("levene_p")), tail)
    return _check(lev, test, "equal_variances", ok, F.col("levene_f"), note)


def homoscedasticity_check(residuals: DataFrame) -> DataFrame:
    r = residuals.agg(F.corr(F.col("fitted"), F.abs("residual")).alias("r"))
    ok = F.coalesce(F.abs("r") < 0.3, F.lit(False))
    tail = F.when(ok, "No major heteroscedasticity.").otherwise("Possible heteroscedasticity detected.")
    note = F.concat(F.format_string("Fitted vs |residual| correlation = %.3f. ", "r"), tail)
    return _check(r, "regression", "homoscedasticity", ok, F.col("r"), note)


def multicollinearity_check(complete: DataFrame, predictors: list[str]) -> DataFrame:
    r = correlation.correlate(complete, predictors).agg(F.max(F.abs("r")).alias("r"))
    ok = F.coalesce(F.col("r") < 0.9, F.lit(False))
    tail = F.when(ok, "Acceptable.").otherwise("High multicollinearity detected.")
    note = F.concat(F.format_string("Max predictor correlation = %.3f. ", "r"), tail)
    return _check(r, "regression", "multicollinearity", ok, F.col("r"), note)


def expected_count_check(df: DataFrame, var1: str, var2: str) -> DataFrame:
    low = crosstab.chi_square(df, var1, var2).select(F.col("min_expected").alias("e"))
    ok = F.col("e") >= 5
    note = F.when(ok, "All expected cell frequencies are ≥ 5.").otherwise(
        "Some expected frequencies < 5. Chi-square may not be reliable.")
    return _check(low, "chi_square", "expected_counts", ok, F.col("e"), note)


GROUP_TESTS = ("t_test", "anova", "mann_whitney", "kruskal_wallis")


def check_assumptions(df: DataFrame, test: str, params: dict, order: list[str], known: dict | None = None) -> DataFrame | None:
    """All checks of a test in report order; None for tests that assume nothing. `known` are the `figures_of` its variable."""
    parts = []
    value, group = params.get("numeric_var") or params.get("dependent"), params.get("group_var")
    if test in GROUP_TESTS and value and group:
        parts = [sample_size_check(df, test, value, known), normality_check(df, test, value, known=known),
                 outlier_check(df, test, value, known)]
        if test in ("t_test", "anova"):
            parts.append(variance_check(df, test, value, group))
    elif test == "regression" and value and params.get("predictors"):
        predictors = params["predictors"]
        rows = regression.residual_rows(df, value, predictors, [o for o in order if o not in (value, *predictors)])
        parts = [normality_check(rows, test, "residual", "residual_normality"), homoscedasticity_check(rows)]
        if len(predictors) > 1:
            parts.append(multicollinearity_check(regression.complete_rows(df, value, predictors), predictors))
    elif test == "chi_square" and params.get("var1") and params.get("var2"):
        parts = [expected_count_check(df, params["var1"], params["var2"])]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def score(checks: DataFrame) -> DataFrame:
    """Passed share of the checks of each test."""
    failed = F.array_compact(F.transform(
        F.sort_array(F.collect_list(F.struct("check_id", "passed", "name"))),
        lambda x: F.when(~x["passed"], x["name"])))
    return checks.groupBy("test").agg(
        F.round(F.try_divide(F.count_if("passed"), F.count("*")), 4).alias("score"),
        F.count_if("passed").alias("passed_count"), F.count("*").alias("total_count"), failed.alias("_failed"))


def soundness(scored: DataFrame, min_score: float = fv.SOUND_SCORE) -> DataFrame:
    """Verdict and recommendation sentence per test."""
    ok = F.col("score") >= min_score
    percent = F.format_string("%.1f%%", F.col("score") * 100)
    good = F.concat(F.lit("This test is statistically sound for your data (score: "), percent, F.lit(")."),
                    F.when(F.col("score") < fv.REVIEW_SCORE,
                           " Consider reviewing the assumption details below.").otherwise(""))
    bad = F.concat(F.lit("This test may NOT be appropriate for your data (score: "), percent,
                   F.lit("). Failed assumptions: "), F.array_join("_failed", ", "),
                   F.lit(". Consider using an alternative test."))
    return scored.select("test", "score", "passed_count", "total_count", ok.alias("sound"),
                         F.when(ok, good).otherwise(bad).alias("recommendation"))
