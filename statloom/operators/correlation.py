"""Pearson and Spearman pairs."""

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.functions.scalars import p_text, stars, strength_text
from statloom.functions.tails import t_two_sided
from statloom.operators.naming import plain_names
from statloom.operators.ranks import average_ranks
from statloom.operators.skew import lookup_by_key
from statloom.operators.summaries import numeric


@plain_names("columns", "by", told=("variable_1", "variable_2"))
def correlate(complete: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """All pairs in one aggregate over complete rows, then p from the t transform of r."""
    by = list(by)
    rows = F.array(*[F.struct(F.lit(a).alias("variable_1"), F.lit(b).alias("variable_2"),
                              F.corr(a, b).alias("r"), F.count("*").alias("n")) for a, b in combinations(columns, 2)])
    pairs = complete.groupBy(*by).agg(rows.alias("_r")).select(*by, F.inline("_r"))
    r, dof = F.col("r"), (F.col("n") - 2).cast("double")
    t = r * F.sqrt(F.try_divide(dof, 1 - r * r))
    p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_two_sided(t, dof))
    return (pairs.withColumn("p_value", p).withColumn("p_display", p_text(F.col("p_value")))
            .withColumn("significance", stars(F.col("p_value"))).withColumn("strength", strength_text(F.col("r"))))


@plain_names("columns", "by", told=("variable_1", "variable_2"))
def pearson(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    return correlate(numeric(df, columns).select(*by, *columns).dropna(subset=columns), columns, by)


@plain_names("columns", "by", told=("variable_1", "variable_2"))
def spearman(df: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Pearson on average ranks; only the ranks of distinct values are written, the rows look them up in one plan."""
    by = list(by)
    complete = numeric(df, columns).select(*by, *columns).dropna(subset=columns)
    ranked = complete
    for c in columns:
        table = average_ranks(complete, c, by).select(*by, c, F.col("rank").alias(f"_rank_{c}"))
        ranked = lookup_by_key(ranked, table, [*by, c])
    return correlate(ranked.select(*by, *[F.col(f"_rank_{c}").alias(c) for c in columns]), columns, by)


def smallest_p(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.min("p_value").alias("min_p"))


def heat_map(pairs: DataFrame) -> DataFrame:
    """Lower-triangle cells with the bubble size and sign colour of each pair."""
    return pairs.select("variable_1", "variable_2", "r", (F.abs("r") * 500 + 30).alias("bubble_size"),
                        F.when(F.col("r") > 0, "positive").otherwise("negative").alias("sign"))
