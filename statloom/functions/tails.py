"""Vectorised UDFs for tail probabilities, applied to result rows only."""

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from statloom.functions import special


@F.pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(2 * special.t_sf(t.abs().to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.t_ppf(p.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(special.f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(special.chi2_sf(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(2 * special.norm_sf(z.abs().to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return pd.Series(special.norm_sf(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(special.norm_ppf(p.to_numpy(float)))
