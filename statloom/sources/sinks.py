"""Result sinks: one folder per table, saved analyses as JSON rows."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.functions.scalars import guard_formula

ANALYSIS_SCHEMA = "analysis_type string, params map<string,string>, results map<string,string>"


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> str:
    """Write one table; text cells are guarded against formula evaluation in CSV output, dates as ISO text."""
    path = f"{folder}/{name}"
    if fmt == "csv":
        texts = {c: guard_formula(F.col(c)) for c, t in df.dtypes if t == "string"}
        df.withColumns(texts).write.mode("overwrite").option("header", True).option("escape", "\"").option(
            "dateFormat", "yyyy-MM-dd").csv(path)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
    return path


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    return {name: write_table(df, folder, name, fmt) for name, df in tables.items()}


def extract_variables(params: Column) -> Column:
    """Distinct variable names out of a params struct, in key order; list keys are spread, empty ones skipped."""
    parts = []
    for key in fv.VARIABLE_KEYS:
        one = F.get_json_object(params, f"$.{key}")
        many = F.from_json(one, "array<string>")
        parts.append(F.when(one.startswith("["), many).when(F.length(one) > 0, F.array(one)).otherwise(
            F.array().cast("array<string>")))
    return F.array_distinct(F.array_compact(F.flatten(F.array(*parts))))


def strip_charts(results: Column) -> tuple[Column, Column]:
    """Chart count and titles that stand in for the images of a result."""
    return F.size(results), F.transform(results, lambda c: c["title"])


def analysis_row(df: DataFrame, analysis: Column, dataset: Column, params: Column, results: Column,
                 interpretation: Column, keep: list[str] = ()) -> DataFrame:
    """One row per finished analysis, structures as JSON text."""
    name = F.when(dataset.isNull() | (dataset == ""), "Untitled dataset").otherwise(dataset)
    return df.select(*keep, analysis.alias("analysis_type"), name.alias("dataset_name"),
                     F.to_json(extract_variables(F.to_json(params))).alias("variables"),
                     F.to_json(params).alias("parameters"), F.to_json(results).alias("results"),
                     F.coalesce(interpretation, F.lit("")).alias("interpretation"))


def read_variants(df: DataFrame, columns: list[str] = ("variables", "parameters", "results")) -> DataFrame:
    """Saved analyses with their JSON columns as VARIANT: results of unlike shape stand in one column and are read by path
    (`try_variant_get`), without a schema of the caller's. Text that is no JSON becomes null."""
    return df.withColumns({c: F.try_parse_json(F.col(c)) for c in columns if c in df.columns})


def result_shapes(df: DataFrame, column: str = "results", by: list[str] = ("analysis_type",)) -> DataFrame:
    """(by, shape, n): the shapes that results have, unreadable ones as null."""
    return df.groupBy(*by, F.schema_of_variant(F.col(column)).alias("shape")).agg(F.count("*").alias("n"))


def read_analysis(df: DataFrame, results_schema: str) -> DataFrame:
    """JSON text back to structures; unreadable text becomes null structures."""
    return df.withColumns({"variables": F.from_json("variables", "array<string>"),
                           "results": F.from_json("results", results_schema)})
