"""Outlier fences, outlier rows and imputation."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.operators.naming import col, plain_names
from statloom.operators.ranks import counted, quantiles
from statloom.operators.skew import null_safe_join
from statloom.operators.summaries import numeric

MIN_VALUES = 4


@plain_names("columns", "by", told=("variable",))
def fences(df: DataFrame, columns: list[str], method: str = "iqr", factor: float = fv.OUTLIER_FACTOR,
           by: list[str] = ()) -> DataFrame:
    """(by, variable, low, high); null fences where a column has no spread or fewer than four values."""
    by = list(by)
    num = numeric(df, columns)
    rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.count(c).alias("_n"), F.avg(c).alias("_m"),
                              F.stddev_samp(c).alias("_s")) for c in columns])
    stats = num.groupBy(*by).agg(rows.alias("_r")).select(*by, F.inline("_r"))
    if method == "zscore":
        mid, spread, scale = F.col("_m"), F.col("_s"), F.lit(factor)
        low, high = mid - scale * spread, mid + scale * spread
    else:
        stats = null_safe_join(stats, quantiles(num, columns, [0.25, 0.75], by), [*by, "variable"])
        q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(1))
        spread = q3 - q1
        low, high = q1 - factor * spread, q3 + factor * spread
    usable = (F.col("_n") >= MIN_VALUES) & (spread > 0)
    return stats.select(*by, "variable", F.when(usable, low).alias("low"), F.when(usable, high).alias("high"))


def _one_row(limits: DataFrame) -> DataFrame:
    """All fences as one map, so that rows are compared against a scalar instead of being joined."""
    return limits.groupBy().agg(F.map_from_entries(F.collect_list(
        F.struct("variable", F.struct("low", "high")))).alias("m"))


@plain_names("columns", "row_id", told=("variable",))
def outlier_rows(df: DataFrame, columns: list[str], row_id: str, method: str = "iqr",
                 factor: float = fv.OUTLIER_FACTOR) -> DataFrame:
    """Long outlier report (row id, column, value): one scan, compared with the fences as a scalar map."""
    limits = _one_row(fences(df, columns, method, factor)).select("m").scalar()
    num = numeric(df, columns)

    def hit(c):
        fence = F.element_at(limits, F.lit(c))
        out = (F.col(c) < fence["low"]) | (F.col(c) > fence["high"])
        return F.when(out, F.struct(F.lit(c).alias("variable"), F.col(c).alias("value")))

    return (num.select(row_id, F.array_compact(F.array(*[hit(c) for c in columns])).alias("_hits"))
            .select(row_id, F.inline("_hits")))


def rows_beyond(df: DataFrame, limits: dict[str, tuple[float, float]], row_id: str) -> DataFrame:
    """The outlier report for fences that are known already, a pair per column."""
    num = numeric(df, list(limits))
    hits = [F.when((col(c) < low) | (col(c) > high), F.struct(F.lit(c).alias("variable"), col(c).alias("value"))) for c, (low, high) in limits.items()]
    none = F.array().cast("array<struct<variable:string,value:double>>")
    return num.select(col(row_id), (F.array_compact(F.array(*hits)) if hits else none).alias("_hits")).select(col(row_id), F.inline("_hits"))


def outlier_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("variable").agg(F.count("*").alias("outliers"))


@plain_names("numeric_cols", "category_cols", told=("variable",))
def fill_values(df: DataFrame, numeric_cols: list[str], category_cols: list[str], strategy: str = "median") -> DataFrame:
    """(variable, fill_number, fill_text): the value that replaces missing cells, null for empty columns."""
    parts = []
    num = numeric(df, numeric_cols)
    none_text, none_num = F.lit(None).cast("string"), F.lit(None).cast("double")
    if numeric_cols and strategy == "mean":
        rows = F.array(*[F.struct(F.lit(c).alias("variable"), F.avg(c).alias("v")) for c in numeric_cols])
        agg = num.agg(rows.alias("_r")).select(F.inline("_r"))
        parts.append(agg.select("variable", F.col("v").alias("fill_number"), none_text.alias("fill_text")))
    elif numeric_cols and strategy == "median":
        q = quantiles(num, numeric_cols, [0.5])
        parts.append(q.select("variable", F.get("q", F.lit(0)).alias("fill_number"), none_text.alias("fill_text")))
    elif numeric_cols:
        parts += [_mode(num, c).select(F.lit(c).alias("variable"), F.col("v").alias("fill_number"),
                                       none_text.alias("fill_text")) for c in numeric_cols]
    parts += [_mode(df, c).select(F.lit(c).alias("variable"), none_num.alias("fill_number"),
                                  F.col("v").cast("string").alias("fill_text")) for c in category_cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _mode(df: DataFrame, c: str) -> DataFrame:
    """Most frequent value, the lowest on ties: two combining aggregates, no value list in memory."""
    counts = counted(df, c)
    best = counts.groupBy("n").agg(F.min(c).alias("v"))
    return best.agg(F.max_by("v", "n").alias("v"))


def impute(df: DataFrame, numeric_cols: list[str], category_cols: list[str], strategy: str = "median") -> DataFrame:
    """Fill missing cells; `leave` returns the table as it is. Other column types are never touched."""
    if strategy == "leave" or not (numeric_cols or category_cols):
        return df
    fills = fill_values(df, numeric_cols, category_cols, strategy)
    packed = fills.groupBy().agg(F.map_from_entries(F.collect_list(
        F.struct("variable", F.struct("fill_number", "fill_text")))).alias("m"))
    fill = packed.select("m").scalar()
    num = numeric(df, numeric_cols)
    exprs = {c: F.coalesce(col(c), F.element_at(fill, F.lit(c))["fill_number"]) for c in numeric_cols}
    exprs |= {c: F.coalesce(col(c), F.element_at(fill, F.lit(c))["fill_text"]) for c in category_cols}
    return num.withColumns(exprs)


def log_transform(df: DataFrame, column: str) -> DataFrame:
    """Add `<column>_log`; a column with a value at or below zero is first moved so that its minimum is one."""
    num = numeric(df, [column])
    low = num.agg(F.min(col(column))).scalar()
    shift = F.when(low <= 0, 1 - low).otherwise(F.lit(0.0))
    return num.withColumn(f"{column}_log", F.ln(col(column) + shift))
