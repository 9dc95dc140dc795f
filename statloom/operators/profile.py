"""Column profile: semantic types, mixed columns, summaries, from one value-count frame.

Every column is reduced to its distinct values with counts in a single shuffle (`value_counts`), so parsing
runs once per distinct value and a value that fills the table is combined before it moves.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.functions.parsing import is_boolean_token, parse_date, parse_number
from statloom.operators.naming import col, plain_names
from statloom.session import literal_rows


@plain_names("columns", "row_id", "by", told=("variable",))
def value_counts(df: DataFrame, columns: list[str], row_id: str, by: list[str] = ()) -> DataFrame:
    """(by, variable, value, n, first_row) of the text form of every column; missing cells stay as null values."""
    by = list(by)
    text = df.select(*by, row_id, *[F.col(c).cast("string").alias(c) for c in columns])
    return (text.unpivot([*by, row_id], columns, "variable", "value").groupBy(*by, "variable", "value")
            .agg(F.count("*").alias("n"), F.min(row_id).alias("first_row")))


def name_tokens(name: Column) -> Column:
    return F.split(F.lower(name), r"[_\- ]+")


def looks_like_id(name: Column, tokens: list[str] = fv.STUDY_IDENTIFIER_TOKENS) -> Column:
    """Whole-token match against identifier words."""
    return F.arrays_overlap(name_tokens(name), F.array(*[F.lit(t) for t in tokens]))


def profile(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Shares and distinct counts per column; the input of type detection and every later choice."""
    by = list(by)
    held = F.col("value").isNotNull()
    number = parse_number(F.col("value"))
    scored = (counts.withColumn("number", number)
              .withColumn("is_bool", held & is_boolean_token(F.trim("value")))
              .withColumn("is_date", held & parse_date(F.col("value")).isNotNull()))
    n = F.col("n")
    is_num = F.col("number").isNotNull()

    def share(hit):
        return F.try_divide(F.sum(F.when(hit, n).otherwise(0)), F.sum(F.when(held, n).otherwise(0)))

    offender = F.when(held & ~is_num, F.struct("first_row", "value"))
    agg = scored.groupBy(*by, "variable").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(held, n)), F.lit(0)).alias("filled"),
        F.count_if(held).alias("distinct"),
        F.count_distinct("number").alias("distinct_numbers"),
        F.coalesce(F.sum(F.when(is_num, n)), F.lit(0)).alias("numeric_cells"),
        share(F.col("is_bool")).alias("bool_share"), share(is_num).alias("numeric_share"),
        share(F.col("is_date")).alias("date_share"),
        F.coalesce(F.bool_and(F.when(is_num, F.col("number") % 1 == 0)), F.lit(False)).alias("whole"),
        F.min("number").alias("min_number"), F.max("number").alias("max_number"),
        F.min(offender).alias("_offender"))
    return agg.select("*", F.col("_offender.value").alias("first_offender")).drop("_offender")


def semantic_type(prof: DataFrame) -> DataFrame:
    """Add `type`: the first rule that holds, identifiers by column name before any content rule."""
    few = F.col("distinct") <= F.greatest(F.lit(float(fv.CATEGORY_FLOOR)), F.col("filled") * fv.CATEGORY_SHARE)
    scale = (F.col("whole") & (F.col("min_number") >= 0) & (F.col("max_number") <= 10)
             & F.col("distinct_numbers").between(2, 7))
    kind = (F.when(F.col("filled") == 0, "empty")
            .when(looks_like_id(F.col("variable"), fv.IDENTIFIER_TOKENS), "identifier")
            .when(F.col("bool_share") > fv.BOOLEAN_SHARE, "boolean")
            .when((F.col("numeric_share") > fv.NUMERIC_SHARE) & scale, "ordinal")
            .when(F.col("numeric_share") > fv.NUMERIC_SHARE, "numeric")
            .when((F.col("distinct") < 3) & few, "categorical")
            .when(F.col("distinct") < 3, "text")
            .when(F.col("date_share") > fv.DATE_SHARE, "date")
            .when(few, "categorical").otherwise("text"))
    return prof.withColumn("type", kind)


def is_mixed() -> Column:
    return (F.col("numeric_cells") > 0) & (F.col("numeric_cells") < F.col("filled"))


def mixed_columns(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Columns where some but not all filled cells are numbers, with the first five offending values in row order."""
    by = list(by)
    mixed = profile(counts, by).where(is_mixed()).select(*by, "variable", "numeric_cells", "filled")
    bad = counts.where(F.col("value").isNotNull() & parse_number(F.col("value")).isNull())
    first = Window.partitionBy(*by, "variable").orderBy("first_row", "value")
    top = bad.withColumn("_rn", F.row_number().over(first)).where("_rn <= 5")
    samples = top.groupBy(*by, "variable").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rn", "value"))), lambda x: x["value"]).alias("samples"))
    return mixed.join(samples, [*by, "variable"]).select(
        *by, "variable", "numeric_cells", "filled", F.array_join("samples", ", ").alias("samples"))


def top_values(counts: DataFrame, by: list[str]) -> DataFrame:
    """The three most frequent values of each column as one text."""
    order = Window.partitionBy(*by, "variable").orderBy(F.desc("n"), "value")
    ranked = counts.where(F.col("value").isNotNull()).withColumn("_rn", F.row_number().over(order)).where("_rn <= 3")
    packed = F.sort_array(F.collect_list(F.struct("_rn", "value")))
    return ranked.groupBy(*by, "variable").agg(F.array_join(F.transform(packed, lambda x: x["value"]), ", ").alias("top"))


# Values per column that a sketch proposes as frequent, and those that it tracks.
CANDIDATES, TRACKED = 32, 4096


def frequent_values(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """(variable, top, decided): the `k` most frequent filled values of each column as one text, ties in order of the value, without counting every distinct value.

    A mergeable sketch of frequent items proposes CANDIDATES values per column in one scan; a second scan counts exactly these. A value that was not
    proposed occurs at most as often as the sketch says of the last one proposed, or as its error allows, so where the k-th exact count is above that
    the answer is exact (`decided`). Only candidates are shuffled and reach the driver.
    """
    inner = {c: f"_u{i}" for i, c in enumerate(columns)}
    text = df.select(*[col(c).cast("string").alias(u) for c, u in inner.items()])
    got = text.agg(*[F.expr(f"approx_top_k({u}, {CANDIDATES}, {TRACKED})").alias(u) for u in inner.values()], *[F.count(u).alias(f"n{u}") for u in inner.values()]).first()
    proposed, least = [], []
    for c, u in inner.items():
        # an estimate is never too small
        items = [(r["item"], r["count"]) for r in got[u] if r["item"] is not None]
        proposed += [(u, item) for item, _ in items]
        most = max(items[-1][1] if len(got[u]) == CANDIDATES else 0, int(3.5 / TRACKED * got[f"n{u}"]))
        least.append((u, c, most, got[f"n{u}"]))
    spark = df.sparkSession
    # at most CANDIDATES rows per column
    wanted = F.broadcast(literal_rows(spark, proposed, "of string, item string"))
    long = text.unpivot([], list(inner.values()), "variable", "value")
    counts = long.join(wanted, (F.col("variable") == F.col("of")) & (F.col("value") == F.col("item"))).groupBy("variable", "value").agg(F.count("*").alias("n"))
    ordered = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "value"))), 1, k)
    top = counts.groupBy("variable").agg(ordered.alias("t"), F.sum("n").alias("seen"))
    bounds = literal_rows(spark, least, "of string, name string, most long, filled long")
    full = bounds.join(top, F.col("of") == F.col("variable"), "left")
    last = -F.element_at("t", -1)["m"]
    decided = (F.col("filled") == F.coalesce("seen", F.lit(0))) | ((F.size("t") == k) & (last > F.col("most")))
    return full.select(F.col("name").alias("variable"), F.array_join(F.transform("t", lambda x: x["value"]), ", ").alias("top"), F.coalesce(decided, F.lit(False)).alias("decided"))


def summary_rows(stats: DataFrame, top: DataFrame, types: DataFrame, by: list[str]) -> DataFrame:
    full = stats.join(top, [*by, "variable"], "left").join(types, [*by, "variable"], "left")
    sample = (F.when(F.col("type").isin("numeric", "ordinal"),
                     F.format_string("min=%.2f · max=%.2f · mean=%.2f", "min", "max", "mean"))
              .when(F.col("type") == "categorical", F.concat(F.lit("Top: "), F.coalesce("top", F.lit(""))))
              .otherwise(F.coalesce("first_value", F.lit("—"))))
    return full.select(*by, "variable", "type", "mixed", "missing",
                       F.coalesce(F.round(F.try_divide(F.col("missing") * 100.0, F.col("rows")), 1), F.lit(0.0)).alias("missing_percent"),
                       "distinct", F.substring(sample, 1, 80).alias("sample"))


def column_summary(counts: DataFrame, types: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row per column: missing count and share, distinct values, and a sample fitted to its type.

    `types` holds (by, variable, type, mixed). Numbers show their range and mean, categories their three most
    frequent values, other columns the first filled cell.
    """
    by = list(by)
    held = F.col("value").isNotNull()
    number = parse_number(F.col("value"))
    n = F.col("n")
    stats = counts.withColumn("number", number).groupBy(*by, "variable").agg(
        F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(~held, n)), F.lit(0)).alias("missing"),
        F.count_if(held).alias("distinct"), F.min("number").alias("min"), F.max("number").alias("max"),
        F.try_divide(F.sum(F.col("number") * n), F.sum(F.when(F.col("number").isNotNull(), n))).alias("mean"),
        F.min_by(F.when(held, F.col("value")), F.when(held, F.col("first_row"))).alias("first_value"))
    return summary_rows(stats, top_values(counts, by), types, by)


def fast_summary(df: DataFrame, columns: list[str], row_id: str, types: DataFrame, categories: list[str]) -> DataFrame:
    """The same rows without a shuffle of values: distinct counts and the proposals for frequent categories are sketches; the latter are counted.

    `df` holds converted columns: numbers are numeric by type.
    """
    kinds = dict(df.dtypes)
    rows = []
    for c in columns:
        s = F.col(c).cast("string")
        num = F.lit(None).cast("double") if kinds[c] in ("string", "date", "boolean") else F.col(c).cast("double")
        rows.append(F.struct(
            F.lit(c).alias("variable"), F.count("*").alias("rows"), F.count_if(F.col(c).isNull()).alias("missing"),
            F.hll_sketch_estimate(F.hll_sketch_agg(s, 16)).alias("distinct"), F.min(num).alias("min"),
            F.max(num).alias("max"), F.avg(num).alias("mean"),
            F.min_by(s, F.when(s.isNotNull(), F.col(row_id))).alias("first_value")))
    stats = df.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))
    if categories:
        found = frequent_values(df, categories)
        top = found.select("variable", F.concat("top", F.when(F.col("decided"), "").otherwise(" (approximate)")).alias("top"))
    else:
        top = stats.select("variable", F.lit("").alias("top")).limit(0)
    return summary_rows(stats, top, types, [])


def fast_profile(df: DataFrame, columns: list[str], row_id: str) -> DataFrame:
    """The same shares in one scan without a shuffle of values; distinct counts are sketches.

    For tables whose columns are close to unique everywhere, where exact distinct counts would move the table.
    """
    index = range(len(columns))
    text = df.select(row_id, *[F.col(c).cast("string").alias(f"_s{i}") for i, c in enumerate(columns)])
    parsed = text.withColumns({f"_n{i}": parse_number(F.col(f"_s{i}")) for i in index}
                              | {f"_d{i}": parse_date(F.col(f"_s{i}")) for i in index})
    rows = []
    for i, c in enumerate(columns):
        s, num = F.col(f"_s{i}"), F.col(f"_n{i}")
        held = F.count(s)
        odd = s.isNotNull() & num.isNull()
        rows.append(F.struct(
            F.lit(c).alias("variable"), F.count("*").alias("rows"), held.alias("filled"),
            F.hll_sketch_estimate(F.hll_sketch_agg(s, 16)).alias("distinct"),
            F.hll_sketch_estimate(F.hll_sketch_agg(num.cast("string"), 16)).alias("distinct_numbers"), F.count(num).alias("numeric_cells"),
            F.try_divide(F.count_if(is_boolean_token(F.trim(s))), held).alias("bool_share"),
            F.try_divide(F.count(num), held).alias("numeric_share"),
            F.try_divide(F.count(f"_d{i}"), held).alias("date_share"),
            F.coalesce(F.bool_and(num % 1 == 0), F.lit(False)).alias("whole"),
            F.min(num).alias("min_number"), F.max(num).alias("max_number"),
            F.min_by(s, F.when(odd, F.col(row_id))).alias("first_offender")))
    return parsed.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))
