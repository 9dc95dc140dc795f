"""The cleaning plan for a folder of files as one grouped job.

What a run over one table decides once (types, names, fences, fills, counts) is here a table with a row per file or per file and column; it is
joined to the rows. The number of jobs does not depend on the number of files, and files that share a name stay apart by their path.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.functions.parsing import load_nulls, null_markers, parse_date, parse_number, strip_text, title_case
from statloom.functions.scalars import guard_formula
from statloom.operators import dedup, outliers, profile
from statloom.operators.naming import col
from statloom.operators.ranks import counted, counted_quantiles
from statloom.operators.skew import lookup_by_key
from statloom.plans.cleaning import drop_blank_rows, quality_score, sanitise_names, standard_names, strip_and_null
from statloom.session import settle
from statloom.sources.readers import FILE, ROW_ID, data_columns

#: The column of `read_csv(header=...)` that holds the names of a file's own columns.
HEADER = "_header"
_COLUMN = [FILE, "variable"]


def _headers(df: DataFrame, given: list[str]) -> DataFrame:
    """(file, own): the column names of each file; without a header column those with any cell."""
    if HEADER in df.columns:
        return df.groupBy(FILE).agg(F.min(HEADER).alias("own"))
    held = [F.when(F.count(col(c)) > 0, F.lit(c)) for c in given]
    return df.groupBy(FILE).agg(F.array_compact(F.array(*held)).alias("own"))


def _columns(spark: SparkSession, files: DataFrame, safe: dict[str, str], rename: bool) -> DataFrame:
    """(file, variable, name, position): the columns of each file, by their name inside this plan and by their cleaned name.

    Names are worked out per distinct header; the driver gets each of these once.
    """
    rows = []
    inner = {n.lower(): s for n, s in safe.items()}
    for r in files.select("own").distinct().collect():
        own = [n for n in r["own"] if n.lower() in inner]
        plain = sanitise_names(own)
        clean = standard_names(plain) if rename else plain
        rows += [(r["own"], inner[n.lower()], c, i, c != s) for i, (n, c, s) in enumerate(zip(own, clean, plain))]
    kinds = (pa.list_(pa.string()), pa.string(), pa.string(), pa.int32(), pa.bool_())
    named = pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(("of", "variable", "name", "position", "renamed"), kinds))})
    return files.join(spark.createDataFrame(named), F.col("own") == F.col("of")).select(*_COLUMN, "name", "position", "renamed")


def _long(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """(keep, variable, value) of every cell."""
    return df.select(*keep, *columns).unpivot(keep, columns, "variable", "value")


def _typed(counts: DataFrame, columns: DataFrame) -> DataFrame:
    """(file, variable, name, position, type, filled): a file's columns without any cell go, unless it has no other."""
    prof = profile.profile(counts.withColumn("value", null_markers(F.col("value"))).groupBy(*_COLUMN, "value").agg(
        F.sum("n").alias("n"), F.min("first_row").alias("first_row")), [FILE])
    named = columns.join(prof, _COLUMN).withColumnsRenamed({"variable": "_inner", "name": "variable"})
    typed = profile.semantic_type(named).withColumnsRenamed({"variable": "name", "_inner": "variable"})
    return typed.select(*_COLUMN, "name", "position", "renamed", "type", "filled")


def _cell(c: str, kind: Column) -> Column:
    """The converted cell as text; null where the file has no such column."""
    text = F.col(c)
    return (F.when(kind.isin("numeric", "ordinal"), parse_number(text).cast("string")).when(kind == "date", parse_date(text).cast("string"))
            .when(kind == "categorical", title_case(text)).when(kind.isNotNull(), text))


def _per_file(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(file, name): a map from the columns of a file to a value of each."""
    return df.groupBy(FILE).agg(F.map_from_entries(F.collect_list(F.struct(F.col(key), value))).alias(name))


def _fences(numbers: DataFrame, counts: DataFrame, method: str, factor: float) -> DataFrame:
    """(file, variable, n, mean, median, low, high) of the number columns."""
    stats = numbers.groupBy(*_COLUMN).agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
    stats = stats.join(counted_quantiles(counts, "x", [0.25, 0.5, 0.75], _COLUMN), _COLUMN)
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(2))
    spread = F.col("sd") if method == "zscore" else q3 - q1
    low = F.col("mean") - factor * spread if method == "zscore" else q1 - factor * spread
    high = F.col("mean") + factor * spread if method == "zscore" else q3 + factor * spread
    usable = (F.col("n") >= outliers.MIN_VALUES) & (spread > 0)
    return stats.select(*_COLUMN, "n", "mean", F.get("q", F.lit(1)).alias("median"), F.when(usable, low).alias("low"), F.when(usable, high).alias("high"))


def _modes(counts: DataFrame, value: str) -> DataFrame:
    """(file, variable, fill): the most frequent value, the lowest on ties."""
    best = F.min_by(F.col(value), F.struct(-F.col("n"), F.col(value)))
    return counts.groupBy(*_COLUMN).agg(best.cast("string").alias("fill"))


def _log(stats: DataFrame, strategy: str, method: str, impute: str) -> DataFrame:
    """(file, position, level, stage, detail): the lines of a single run, per file."""
    def line(level, stage, detail, hit=None):
        row = F.struct(F.lit(level).alias("level"), F.lit(stage).alias("stage"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))
        return row if hit is None else F.when(hit, row)

    text = F.format_string
    blank_rows, blank_cols, gone = F.col("blank_rows"), F.col("blank_columns"), F.col("duplicates")
    shown = F.array_join(F.slice("fill_texts", 1, 3), "; ")
    rows = [
        line("ok", "Whitespace stripped", "Column names + string cells cleaned"),
        line("ok", "Null markers standardised", text("%d additional nulls identified", "marked")),
        line("warn", "Blank rows removed", text("%d empty rows dropped", blank_rows), blank_rows > 0),
        line("warn", "Blank columns removed", text("%d empty columns dropped", blank_cols), blank_cols > 0),
        line("ok", "Blank check", "No blank rows/columns detected", (blank_rows == 0) & (blank_cols == 0)),
        line("ok", "Column names sanitised", text("%d columns cleaned", "cols_in")),
        line("ok", "Column names standardised", text("Renamed %d columns", "renamed"), F.col("renamed") > 0),
        line("ok", "Column types detected", F.col("tally")),
        line("ok", "Categories standardised", text("%d columns → Title Case", "categories")),
        line("ok", "Dates standardised", text("%d date columns → YYYY-MM-DD", "dates")),
        line("ok", "Currency / numerics parsed", text("%d columns parsed → float", "numbers")),
        line("warn", "Duplicate report", text("%d rows are duplicates (kept, flagged)", gone), (gone > 0) & F.lit(strategy == "report")),
        line("warn", "Duplicate rows removed", text(f"%d duplicates dropped (strategy: {strategy})", gone), (gone > 0) & F.lit(strategy != "report")),
        line("ok", "Duplicate check", "No duplicate rows found", gone == 0),
        line("warn", "Outliers flagged", F.array_join(F.transform("outlier_counts", lambda x: F.concat(
            x["name"], F.lit(": "), x["n"].cast("string"), F.lit(f" outlier(s) ({method})"))), "; "), F.size("outlier_counts") > 0),
        line("ok", "Outlier check", "No statistical outliers detected", F.size("outlier_counts") == 0),
        line("ok", "Missing value check", "Imputation skipped (strategy = 'leave')", F.lit(impute == "leave")),
        line("ok", "Missing values imputed", F.concat(F.lit(f"strategy={impute} → "), shown), F.size("fill_texts") > 0),
        line("ok", "...", text("And %d more columns", F.size("fill_texts") - 3), F.size("fill_texts") > 3),
        line("ok", "Missing value check", "No imputation needed", F.lit(impute != "leave") & (F.size("fill_texts") == 0)),
        line("ok", "Column summary generated", text("%d columns", "columns")),
        line("ok", "Data quality scored", F.concat(F.lit("Overall Data Quality: "), F.col("quality_score").cast("string"), F.lit("%"))),
    ]
    return stats.select(FILE, F.posexplode(F.array_compact(F.array(*rows))).alias("position", "l")).select(FILE, "position", "l.*")


def _advice(summary: DataFrame, mixed: DataFrame, outlier_n: DataFrame, stats: DataFrame, method: str, strategy: str) -> DataFrame:
    """(file, kind, variable, advice): as for a single table; a file with nothing to advise gets one all-clear row."""
    pct = F.col("missing_percent")
    gaps = summary.where(pct >= 10).select(FILE, F.lit(1).alias("kind"), "variable", F.when(
        pct >= 30, F.format_string("'%s' is %.1f%% missing — consider usability.", "variable", pct)).otherwise(
        F.format_string("'%s' has %.1f%% missing — review before conclusions.", "variable", pct)).alias("advice"))
    first_two = F.array_join(F.slice(F.split("samples", ", "), 1, 2), ", ")
    odd = mixed.select(FILE, F.lit(2).alias("kind"), "variable", F.format_string("'%s' has mixed types (e.g., %s) — consider standardising.", "variable", first_two).alias("advice"))
    far = outlier_n.select(FILE, F.lit(3).alias("kind"), F.col("name").alias("variable"), F.format_string(
        f"'%s' contains %d outlier(s) ({method}) — review before modelling.", "name", "n").alias("advice"))
    gone = stats.where(F.col("rows_removed") > 0).select(FILE, F.lit(4).alias("kind"), F.lit("").alias("variable"), F.format_string(
        f"%d duplicate row(s) removed (strategy: {strategy})", "rows_removed").alias("advice"))
    rows = settle(gaps.unionByName(odd).unionByName(far).unionByName(gone))
    clear = stats.join(rows.select(FILE).distinct(), FILE, "left_anti").select(
        FILE, F.lit(5).alias("kind"), F.lit("").alias("variable"), F.lit("No major data quality issues detected.").alias("advice"))
    return rows.unionByName(clear)


def clean_folder(df: DataFrame, folder: str, fmt: str = "parquet", duplicate_strategy: str = "first", impute_strategy: str = "median",
                 outlier_method: str = "iqr", outlier_factor: float = fv.OUTLIER_FACTOR, rename: bool = True) -> DataFrame:
    """Clean every source file of `read_csv` by itself; one row (file, rows, columns, quality_score) per file with any record.

    Below `folder` each table is written once: cleaned_data, partitioned by file, and column_summary, outlier_report, mixed_columns,
    recommendations, cleaning_log, run_stats, which tell the file in a column. A cleaned column is a number or a date where it is one in every file that has it, else text; in the
    rows of a file without it it is null. Pass `read_csv(header=HEADER)` to let columns without any cell count as a file's own.
    """
    spark = df.sparkSession
    given = [c for c in data_columns(df) if c != HEADER]
    safe = dict(zip(given, sanitise_names(given)))
    inner = list(safe.values())
    columns = settle(_columns(spark, _headers(df, given), safe, rename))
    df = df.select(FILE, ROW_ID, *[col(c).cast("string").alias(s) for c, s in safe.items()])

    loaded = df.withColumns({c: load_nulls(strip_text(F.col(c))) for c in inner})
    raw = settle(lookup_by_key(profile.value_counts(loaded, inner, ROW_ID, [FILE]), columns.select(*_COLUMN), _COLUMN))
    value, n = F.col("value"), F.col("n")
    marks = raw.groupBy(*_COLUMN).agg(F.sum("n").alias("rows"), F.sum(F.when(value.isNull(), n).otherwise(0)).alias("missing"),
                                      F.sum(F.when(value.isNotNull() & null_markers(value).isNull(), n).otherwise(0)).alias("marked"))
    marks = marks.groupBy(FILE).agg(F.max("rows").alias("rows_in"), F.sum("missing").alias("missing_before"), F.sum("marked").alias("marked"))
    found = settle(_typed(raw, columns))
    filled = found.groupBy(FILE).agg((F.max("filled") == 0).alias("_empty"))
    kept = settle(found.join(filled, FILE).where("_empty OR filled > 0").drop("_empty"))

    kinds = _per_file(kept, "variable", F.col("type"), "_kinds")
    solid = lookup_by_key(drop_blank_rows(strip_and_null(df, inner), inner), kinds, [FILE])
    converted = solid.select(FILE, ROW_ID, *[_cell(c, F.try_element_at("_kinds", F.lit(c))).alias(c) for c in inner])
    if duplicate_strategy == "report":
        data = settle(dedup.flag_duplicates(converted, [FILE, *inner], ROW_ID).withColumn("_copies", F.lit(1).cast("long")))
        flags = F.count_if("_duplicate_flag")
    else:
        data = settle(dedup.drop_duplicates(converted, [FILE, *inner], ROW_ID, duplicate_strategy, "_copies"))
        flags = F.sum("_copies") - F.count("*")

    sizes = settle(data.groupBy(FILE).agg(F.count("*").alias("rows"), F.sum("_copies").alias("solid"), flags.alias("duplicates"),
                                          F.array(*[F.struct(F.lit(c).alias("variable"), F.count(c).alias("held")) for c in inner]).alias("_held")))
    held = kept.join(sizes.select(FILE, "rows", F.inline("_held")), _COLUMN).withColumn("gaps", F.col("rows") - F.col("held"))
    is_number = F.col("type").isin("numeric", "ordinal")
    cells = _long(data, inner, [FILE, ROW_ID]).where("value IS NOT NULL")
    numbers = lookup_by_key(cells, kept.where(is_number).select(*_COLUMN, "name"), _COLUMN).withColumn("x", F.col("value").try_cast("double"))
    words = lookup_by_key(cells, kept.where("type = 'categorical'").select(*_COLUMN), _COLUMN)
    by_number = settle(counted(numbers, "x", _COLUMN))
    limits = settle(_fences(numbers, by_number, outlier_method, outlier_factor))
    report = settle(lookup_by_key(numbers, limits.select(*_COLUMN, "low", "high"), _COLUMN).where("x < low OR x > high").select(
        FILE, ROW_ID, F.col("name").alias("variable"), F.col("x").alias("value"), F.col("variable").alias("_inner")))
    beyond = report.groupBy(FILE, F.col("_inner").alias("variable")).agg(F.count("*").alias("n"))
    beyond = settle(beyond.join(kept.select(*_COLUMN, "name", "position"), _COLUMN))

    fills = _modes(counted(words, "value", _COLUMN), "value")
    if impute_strategy in ("median", "mean"):
        fills = fills.unionByName(limits.select(*_COLUMN, F.col(impute_strategy).cast("string").alias("fill")))
    else:
        fills = fills.unionByName(_modes(by_number, "x"))
    if impute_strategy == "leave":
        fills = fills.limit(0)
    fills = settle(held.where("gaps > 0").join(fills, _COLUMN).where("fill IS NOT NULL"))
    shown = F.when(F.col("type") == "categorical", F.concat(F.col("name"), F.lit("(mode='"), F.col("fill"), F.lit("')"))).otherwise(
        F.concat(F.col("name"), F.lit(f"({impute_strategy}="), F.format_string("%.2f", F.col("fill").try_cast("double")), F.lit(")")))

    # the cleaned rows, columns by their cleaned names
    maps = _per_file(kept, "variable", F.col("name"), "_names").join(_per_file(fills, "variable", F.col("fill"), "_fills"), FILE, "left")
    rows = lookup_by_key(data, maps, [FILE])
    whole = {c: F.coalesce(F.col(c), F.try_element_at("_fills", F.lit(c))) for c in inner}
    places: dict[str, list[str]] = {}
    sorts: dict[str, set[str]] = {}
    for r in kept.groupBy("name", "variable").agg(F.collect_set("type").alias("types"), F.min("position").alias("at")).orderBy("at", "variable").collect():
        places.setdefault(r["name"], []).append(r["variable"])
        sorts.setdefault(r["name"], set()).update(r["types"])
    out = []
    for name, members in places.items():
        text = F.coalesce(*[F.when(F.try_element_at("_names", F.lit(c)) == name, whole[c]) for c in members])
        kind = "double" if sorts[name] <= {"numeric", "ordinal"} else "date" if sorts[name] == {"date"} else "string"
        out.append(text.try_cast(kind).alias(name))
    flag = ["_duplicate_flag"] if duplicate_strategy == "report" else []
    cleaned = rows.select(FILE, ROW_ID, *out, *flag)

    final = settle(lookup_by_key(profile.value_counts(rows.select(FILE, ROW_ID, *[v.alias(c) for c, v in whole.items()]), inner, ROW_ID, [FILE]),
                                 kept.select(*_COLUMN, "name"), _COLUMN))
    final = final.drop("variable").withColumnRenamed("name", "variable")
    odd = profile.mixed_columns(raw, [FILE]).join(columns.select(*_COLUMN, "name"), _COLUMN)
    odd = settle(odd.select(FILE, F.col("name").alias("variable"), "numeric_cells", "filled", "samples"))
    types = kept.select(FILE, F.col("name").alias("variable"), "type", "position").join(odd.select(FILE, "variable", F.lit(True).alias("mixed")), _COLUMN, "left")
    types = types.withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    summary = settle(profile.column_summary(final, types.drop("position"), [FILE]))

    def per_file(part, *aggs):
        return part.groupBy(FILE).agg(*aggs)

    def count_of(hit, name):
        return F.count_if(hit).alias(name)

    tally = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "k"))), lambda x: F.concat(x["type"], F.lit(":"), x["k"].cast("string"))), ", ")
    order = F.transform(F.array_sort(F.collect_list(F.struct("position", "name", "n"))), lambda x: F.struct(x["name"].alias("name"), x["n"].alias("n")))
    parts = [
        marks, sizes.select(FILE, "rows", "solid", "duplicates"),
        per_file(found, F.count("*").alias("cols_in"), F.count_if("renamed").alias("renamed")),
        per_file(kept, F.count("*").alias("columns"), count_of(is_number, "numbers"), count_of(F.col("type") == "date", "dates"), count_of(F.col("type") == "categorical", "categories")),
        kept.groupBy(FILE, "type").agg(F.count("*").alias("k")).groupBy(FILE).agg(tally.alias("tally")),
        per_file(held.join(fills.select(*_COLUMN, F.lit(True).alias("_done")), _COLUMN, "left"),
                 F.sum(F.when(F.col("_done"), 0).otherwise(F.col("gaps"))).alias("missing_after"),
                 F.sum(F.when(F.col("_done") | (F.col("type") != "date"), 0).otherwise(F.col("gaps"))).alias("bad_dates")),
        per_file(beyond, order.alias("outlier_counts"), F.sum("n").alias("outliers")),
        fills.groupBy(FILE).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("position"), shown.alias("t")))), lambda x: x["t"]).alias("fill_texts")),
        per_file(odd, F.count("*").alias("mixed_columns"))]
    stats = parts[0]
    for p in parts[1:]:
        stats = stats.join(p, FILE, "left")
    none = F.array().cast("array<struct<name:string,n:bigint>>")
    stats = stats.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("rows", "solid", "duplicates", "outliers", "mixed_columns", "missing_after", "bad_dates")} | {
        "outlier_counts": F.coalesce("outlier_counts", none), "fill_texts": F.coalesce("fill_texts", F.array().cast("array<string>"))})
    stats = stats.withColumns({"blank_rows": F.col("rows_in") - F.col("solid"), "blank_columns": F.col("cols_in") - F.col("columns"), "rows_removed": F.col("rows_in") - F.col("rows")})
    score = quality_score(F.col("rows") * F.col("columns"), F.col("missing_after"), F.col("rows"), F.col("outliers"), F.col("bad_dates"), F.col("rows") * F.col("dates"),
                          F.col("rows_removed"), F.col("rows_in"), F.col("mixed_columns"), F.col("columns"))
    stats = settle(stats.withColumn("quality_score", score))
    extra = F.when(F.col("duplicates") > 0, len(flag)).otherwise(0)
    metrics = {"rows_in": "rows_in", "cols_in": "cols_in", "rows_out": "rows", "cols_out": F.col("columns") + extra, "rows_removed": "rows_removed",
               "missing_before": "missing_before", "missing_after": "missing_after", "impute_strategy": F.lit(impute_strategy),
               "duplicate_strategy": F.lit(duplicate_strategy), "outlier_method": F.lit(outlier_method), "mixed_columns": "mixed_columns",
               "data_quality_score": "quality_score"}
    listed = F.array(*[F.struct(F.lit(k).alias("metric"), (F.col(v) if isinstance(v, str) else v).cast("string").alias("value")) for k, v in metrics.items()])
    tables = {
        "cleaned_data": cleaned, "column_summary": summary, "outlier_report": report.drop("_inner"), "mixed_columns": odd,
        "recommendations": _advice(summary, odd, beyond, stats, outlier_method, duplicate_strategy),
        "cleaning_log": _log(stats, duplicate_strategy, outlier_method, impute_strategy), "run_stats": stats.select(FILE, F.inline(listed)),
    }
    for name, part in tables.items():
        _write(part, f"{folder}/{name}", fmt, name == "cleaned_data")
    return stats.select(F.col(FILE).alias("file"), "rows", "columns", "quality_score").orderBy("file")


def _write(part: DataFrame, path: str, fmt: str, by_file: bool) -> None:
    """One write; text cells are guarded against formula evaluation in CSV output."""
    writer = part.write
    if fmt == "csv":
        writer = part.withColumns({c: guard_formula(F.col(c)) for c, t in part.dtypes if t == "string" and c != FILE}).write
        writer = writer.option("header", True).option("escape", "\"").option("dateFormat", "yyyy-MM-dd")
    if by_file:
        writer = writer.partitionBy(FILE)
    writer.mode("overwrite").format(fmt).save(path)
