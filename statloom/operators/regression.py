"""Least squares from one aggregate of means and covariances; only k-by-k systems are solved in Python."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions import special
from statloom.functions.scalars import p_text, r4, stars
from statloom.operators.naming import col, plain_names
from statloom.operators.summaries import numeric

_COEF = ("predictor string, position int, b double, std_error double, t double, p double, n long, k int, "
         "r_squared double, adj_r_squared double, f_statistic double, f_p double, mse double, mean_x double, sxx double")


@plain_names("dependent", "predictors", "by")
def complete_rows(df: DataFrame, dependent: str, predictors: list[str], by: list[str] = ()) -> DataFrame:
    cols = [dependent, *predictors]
    return numeric(df, cols).select(*by, *cols).dropna(subset=cols)


def moments(complete: DataFrame, dependent: str, predictors: list[str], by: list[str] = ()) -> DataFrame:
    """Row count, means and the covariance matrix of (predictors, dependent), one row per segment."""
    cols = [*predictors, dependent]
    cov = [F.covar_samp(cols[i], cols[j]) for i in range(len(cols)) for j in range(i + 1)]
    return complete.groupBy(*by).agg(F.count("*").alias("_n"), F.array(*[F.avg(c) for c in cols]).alias("_means"),
                                     F.array(*cov).alias("_cov"))


def _fit(n: int, means: np.ndarray, packed: np.ndarray, names: list[str]) -> list[list]:
    k = len(names)
    cov = np.zeros((k + 1, k + 1))
    cov[np.tril_indices(k + 1)] = packed
    cov = cov + np.tril(cov, -1).T
    sxx, sxy, syy = cov[:k, :k] * (n - 1), cov[:k, k] * (n - 1), cov[k, k] * (n - 1)
    inverse = np.linalg.pinv(sxx, hermitian=True)
    slope = inverse @ sxy
    intercept = means[k] - means[:k] @ slope
    sse = max(syy - slope @ sxy, 0.0)
    r2 = 1 - sse / syy if syy > 0 else 0.0
    dof = n - k - 1
    mse = sse / dof if dof > 0 else sse
    se = np.sqrt(mse * np.concatenate([[1 / n + means[:k] @ inverse @ means[:k]], np.diag(inverse)]))
    coef = np.concatenate([[intercept], slope])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = coef / se
        f = (r2 / k) / ((1 - r2) / dof) if dof > 0 else np.nan
    p = 2 * special.t_sf(np.abs(t), np.full(k + 1, float(dof)))
    adj = 1 - (1 - r2) * (n - 1) / dof if dof > 0 else r2
    f_p = float(special.f_sf(f, float(k), float(dof))) if dof > 0 else np.nan
    out = []
    for i, name in enumerate(["(Intercept)", *names]):
        centre, spread = (None, None) if i == 0 else (float(means[i - 1]), float(sxx[i - 1, i - 1]))
        out.append([name, i, coef[i], se[i], t[i], p[i], n, k, r2, adj, f, f_p, mse, centre, spread])
    return out


@plain_names("dependent", "predictors", "by", told=("predictor",))
def coefficients(df: DataFrame, dependent: str, predictors: list[str], by: list[str] = ()) -> DataFrame:
    """One row per coefficient, the model figures repeated on each."""
    by = list(by)
    rows = moments(complete_rows(df, dependent, predictors, by), dependent, predictors, by)
    types = dict(rows.dtypes)
    schema = ", ".join([f"`{b}` {types[b]}" for b in by] + [_COEF])

    def fit(batches):
        for pdf in batches:
            out = []
            for rec in pdf.to_dict("records"):
                if rec["_n"] > len(predictors) + 1:
                    fitted = _fit(int(rec["_n"]), np.array(rec["_means"]), np.array(rec["_cov"]), predictors)
                    out += [[rec[b] for b in by] + line for line in fitted]
            yield pd.DataFrame(out, columns=[*by, *[c.split()[0] for c in _COEF.split(", ")]])

    return rows.mapInPandas(fit, schema)


def _segments(coefs: DataFrame, by: list[str]) -> list:
    """The segment columns of a coefficient table, which come first and may have got another name."""
    return [col(c) for c in coefs.columns[:len(by)]]


def coef_table(df: DataFrame, dependent: str, predictors: list[str], by: list[str] = ()) -> DataFrame:
    c = coefficients(df, dependent, predictors, by)
    return c.select(*_segments(c, by), "predictor", "position", r4("b").alias("b"), r4("std_error").alias("std_error"),
                    r4("t").alias("t"), r4("p").alias("p"), stars(F.col("p")).alias("significance"))


def equation_text(coefs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Equation with coefficients rounded to four places, in predictor order."""
    term = F.struct("position", F.when(F.col("position") == 0, F.round("b", 4).cast("string")).otherwise(
        F.concat(F.round("b", 4).cast("string"), F.lit("×"), F.col("predictor"))).alias("text"))
    packed = coefs.groupBy(*by).agg(F.sort_array(F.collect_list(term)).alias("_t"))
    return packed.select(*by, F.concat(F.lit("ŷ="), F.array_join(F.transform("_t", lambda x: x["text"]), "+"))
                         .alias("equation"))


def model_summary(df: DataFrame, dependent: str, predictors: list[str], by: list[str] = ()) -> DataFrame:
    """One row per model: fit, F test and equation."""
    coefs = coefficients(df, dependent, predictors, by)
    by = _segments(coefs, by)
    term = F.struct("position", F.when(F.col("position") == 0, F.round("b", 4).cast("string")).otherwise(
        F.concat(F.round("b", 4).cast("string"), F.lit("×"), F.col("predictor"))).alias("text"))
    figures = ["n", "k", "r_squared", "adj_r_squared", "f_statistic", "f_p"]
    packed = coefs.groupBy(*by).agg(*[F.max(c).alias(c) for c in figures],
                                    F.sort_array(F.collect_list(term)).alias("_t"))
    equation = F.concat(F.lit("ŷ="), F.array_join(F.transform("_t", lambda x: x["text"]), "+"))
    return (packed.withColumn("equation", equation).drop("_t").withColumnRenamed("f_p", "p_value")
            .withColumn("p_display", p_text(F.col("p_value"))).withColumn("significance", stars(F.col("p_value"))))


@plain_names("dependent", "predictors", "keep")
def residual_rows(df: DataFrame, dependent: str, predictors: list[str], keep: list[str] = ()) -> DataFrame:
    """Fitted value and residual of every complete row; the few coefficients are worked out first."""
    cols = [dependent, *predictors]
    beta = {r["position"]: r["b"] for r in coefficients(df, dependent, predictors).select("position", "b").collect()}
    rows = numeric(df, cols).dropna(subset=cols)
    fitted = F.lit(beta.get(0)).cast("double")
    for i, c in enumerate(predictors, 1):
        fitted = fitted + F.lit(beta.get(i)).cast("double") * F.col(c)
    return rows.select(*keep, *cols, fitted.alias("fitted")).withColumn("residual", F.col(dependent) - F.col("fitted"))
