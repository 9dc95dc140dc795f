"""The cleaning plan: fourteen steps on immutable frames.

Pass 1 counts the distinct values of every raw column (types, mixed columns, distinct counts of the result). Pass 2 converts the cells and
drops duplicates, its result written once. The quartiles of all numbers are narrowed together and give fences and fills; a last
pass writes the outlier report. Counts are observed on these writes instead of being jobs of their own.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.functions.parsing import clean_cell, load_nulls, null_markers, parse_date, parse_number, strip_text, title_case
from statloom.operators import dedup, outliers, profile, ranks
from statloom.operators.naming import col
from statloom.session import dealt, literal_rows, settle
from statloom.sources.readers import FILE, ROW_ID


# Columns with missing cells that the text form of the preview lists.
PREVIEW_COLUMNS = 5


@dataclass
class CleanResult:
    """The cleaned table and its side tables."""

    data: DataFrame
    types: dict[str, str]
    log: list[tuple[str, str, str]]
    stats: dict[str, object]
    tables: dict[str, DataFrame] = field(default_factory=dict)


def sanitise_names(names: list[str]) -> list[str]:
    """Word characters only, a letter first, repeats numbered from two."""
    out: list[str] = []
    used: dict[str, int] = {}
    for position, raw in enumerate(names, 1):
        name = re.sub(r"[^A-Za-z0-9_]", "", re.sub(r"\s+", "_", raw.strip()))
        if not name:
            name = f"col_{position}"
        elif not name[0].isalpha():
            name = f"col_{name}"
        out.append(_unused(name, used))
    return out


def standard_names(names: list[str]) -> list[str]:
    """Names whose words match a known synonym take its standard form; collisions are numbered."""
    used: dict[str, int] = {}
    out = []
    for name in names:
        words = name.lower().split("_")
        found = fv.COLUMN_NAME_SYNONYMS.get(name.lower()) or next(
            (fv.COLUMN_NAME_SYNONYMS[w] for w in words if w in fv.COLUMN_NAME_SYNONYMS), None)
        out.append(_unused(found or name, used))
    return out


def _unused(name: str, used: dict[str, int]) -> str:
    key = name.lower()
    if key not in used:
        used[key] = 1
        return name
    while True:
        used[key] += 1
        candidate = f"{name}_{used[key]}"
        if candidate.lower() not in used:
            used[candidate.lower()] = 1
            return candidate


def strip_and_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Trim text cells and turn null markers into nulls, all columns in one projection; NaN becomes null."""
    types = dict(df.dtypes)
    exprs = {}
    for c in columns:
        if types[c] == "string":
            exprs[c] = clean_cell(F.col(c))
        elif types[c] in ("double", "float"):
            exprs[c] = F.nanvl(F.col(c), F.lit(None).cast(types[c]))
    return df.withColumns(exprs)


def marker_columns(df: DataFrame, columns: list[str]) -> list[Column]:
    """Aggregates: rows, blank rows, and missing cells by origin: empty, markers known to file loading, further markers."""
    def total(hits):
        return sum(hits[1:], hits[0]) if hits else F.lit(0)

    raw = [F.count_if(F.col(c).isNull()) for c in columns]
    texts = [F.col(c) for c, t in df.dtypes if c in columns and t == "string"]
    load = [F.count_if(c.isNotNull() & load_nulls(strip_text(c)).isNull()) for c in texts]
    more = [F.count_if(load_nulls(strip_text(c)).isNotNull() & clean_cell(c).isNull()) for c in texts]
    solid = [clean_cell(F.col(c)) if t == "string" else F.nanvl(F.col(c), F.lit(None).cast(t))
             if t in ("double", "float") else F.col(c) for c, t in df.dtypes if c in columns]
    blank = F.coalesce(*[x.cast("string") for x in solid]).isNull()
    return [F.count("*").alias("rows"), F.count_if(blank).alias("blank_rows"), total(raw).alias("raw_missing"),
            total(load).alias("load_missing"), total(more).alias("marker_missing")]


def marker_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*marker_columns(df, columns))


def drop_blank_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop("all", subset=columns)


def convert_cell(c: str, kind: str, dtype: str) -> Column:
    """The cell in the physical type of its semantic type."""
    if dtype != "string":
        return F.col(c)
    if kind in ("numeric", "ordinal"):
        return parse_number(F.col(c))
    if kind == "date":
        return parse_date(F.col(c))
    if kind == "categorical":
        return title_case(F.col(c))
    return F.col(c)


def quality_score(cells: Column, missing: Column, rows: Column, outlier_cells: Column, bad_dates: Column,
                  date_cells: Column, removed: Column, rows_in: Column, mixed: Column, columns: Column) -> Column:
    """100 less the weighted shares of missing cells, outliers, bad dates, removed rows and mixed columns."""
    def ratio(a, b):
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    w = fv.QUALITY_WEIGHTS
    penalty = (ratio(missing, cells) * w["missing"] + ratio(outlier_cells, rows) * w["outlier"]
               + ratio(bad_dates, date_cells) * w["bad_date"] + ratio(removed, rows_in) * w["duplicate"]
               + ratio(mixed, columns) * w["mixed"])
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(100 - penalty, 1)))


def recommendations(summary: DataFrame, mixed: DataFrame, outlier_n: DataFrame, removed: int, method: str,
                    strategy: str) -> DataFrame:
    """Advice rows by kind; one all-clear row when there is nothing to advise."""
    pct = F.col("missing_percent")
    missing = summary.where(pct >= 10).select(
        F.lit(1).alias("kind"), "variable",
        F.when(pct >= 30, F.format_string("'%s' is %.1f%% missing — consider usability.", "variable", pct)).otherwise(
            F.format_string("'%s' has %.1f%% missing — review before conclusions.", "variable", pct)).alias("advice"))
    first_two = F.array_join(F.slice(F.split("samples", ", "), 1, 2), ", ")
    mixed_rows = mixed.select(F.lit(2).alias("kind"), "variable", F.format_string(
        "'%s' has mixed types (e.g., %s) — consider standardising.", "variable", first_two).alias("advice"))
    out_rows = outlier_n.select(F.lit(3).alias("kind"), "variable", F.format_string(
        f"'%s' contains %d outlier(s) ({method}) — review before modelling.", "variable", "outliers").alias("advice"))
    rows = missing.unionByName(mixed_rows).unionByName(out_rows)
    if removed > 0:
        note = f"{removed} duplicate row(s) removed (strategy: {strategy})"
        extra = summary.sparkSession.range(1).select(F.lit(4).alias("kind"), F.lit("").alias("variable"),
                                                     F.lit(note).alias("advice"))
        return rows.unionByName(extra)
    clear = rows.agg(F.count("*").alias("n")).where("n = 0").select(
        F.lit(5).alias("kind"), F.lit("").alias("variable"), F.lit("No major data quality issues detected.").alias("advice"))
    return rows.unionByName(clear)


def preview(counts: DataFrame, rows: int, duplicates: DataFrame, columns: list[str]) -> DataFrame:
    """Issues found before cleaning: mixed columns, missing cells in all and per column, duplicate rows.

    Every column with missing cells has its row, with its place in the table; the text form shows PREVIEW_COLUMNS of them and
    says how many more there are.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("variable"))
    missing = counts.where(F.col("value").isNull()).groupBy("variable").agg(F.sum("n").alias("n")).withColumn("place", place)
    whole = missing.agg(F.count("*").alias("held"), F.sum("n").alias("n")).where("held > 0")
    lines = profile.mixed_columns(counts).select(
        F.lit("mixed").alias("issue"), "variable", F.col("samples").alias("detail")).unionByName(
        missing.select(F.format_string("missing_%03d", "place").alias("issue"), "variable",
                       F.format_string("%.1f%% missing", F.col("n") * 100.0 / rows).alias("detail"))).unionByName(
        whole.select(F.lit("missing").alias("issue"), F.lit("").alias("variable"),
                     F.concat(F.format_string("%,d missing values in %d columns", "n", "held"),
                              F.when(F.col("held") > PREVIEW_COLUMNS, F.format_string(", %d more than are shown", F.col("held") - PREVIEW_COLUMNS))
                              .otherwise("")).alias("detail")))
    return lines.unionByName(duplicates.where("duplicates > 0").select(
        F.lit("duplicates").alias("issue"), F.lit("").alias("variable"), F.col("duplicates").cast("string").alias("detail")))


def _distinct_after(counts: DataFrame, kinds: dict[str, str], phys: dict[str, str], fills: dict[str, Column]) -> dict[str, int]:
    """Distinct values of every converted column, read from the counted raw values: duplicates that go leave a copy, so no value is lost
    with them, and a fill is one more value where it is new."""
    def form(c):
        return convert_cell("value", kinds[c], phys[c]).cast("string")

    ways = {"numeric": "numeric", "ordinal": "numeric", "date": "date", "categorical": "categorical"}
    groups: dict[str, list[str]] = {}
    for c, kind in kinds.items():
        groups.setdefault(ways.get(kind, "") if phys[c] == "string" else "", []).append(c)
    key = F.coalesce(*[F.when(F.col("variable").isin(members), form(members[0])) for members in groups.values()])
    new = F.create_map(*[x for c, v in fills.items() for x in (F.lit(c), v)]) if fills else F.lit(None).cast("map<string,string>")
    found = counts.withColumn("_key", key).groupBy("variable").agg(
        F.count_distinct("_key").alias("n"), F.bool_or(F.col("_key") == F.try_element_at(new, F.col("variable"))).alias("there"))
    return {r["variable"]: r["n"] + (r["variable"] in fills and not r["there"]) for r in found.collect()}


def clean(df: DataFrame, row_id: str = ROW_ID, duplicate_strategy: str = "first", impute_strategy: str = "median",
          outlier_method: str = "iqr", outlier_factor: float = fv.OUTLIER_FACTOR, rename: bool = True,
          exact: bool = True) -> CleanResult:
    """Run every step and return the cleaned table with log, statistics and side tables.

    Column names are sanitised before anything else, so any name will do. A table without rows keeps its columns, as type `empty`. Counts are
    observed where the converted rows and the outlier report are written; the driver gets a few numbers per column.

    `exact=False` profiles by scans with distinct-count sketches instead of counting every distinct value; meant
    for tables whose columns are close to unique. The given rows are first dealt over the cores, since no shuffle does it. Cleaned
    cells are the same unless a sketch moves a type cut.
    """
    spark = df.sparkSession
    log: list[tuple[str, str, str]] = []
    given = [c for c in df.columns if c not in (row_id, FILE)]
    raw_cols = sanitise_names(given)
    df = df.select(col(row_id), *[col(c).alias(n) for c, n in zip(given, raw_cols)])
    if not exact:
        df = dealt(df.withColumns({c: F.col(c).cast("string") for c, t in df.dtypes if t == "void"}))  # no file holds that type
    loads = {c: load_nulls(strip_text(F.col(c))) for c, t in df.dtypes if c in raw_cols and t == "string"}
    solid = drop_blank_rows(strip_and_null(df, raw_cols), raw_cols)
    names = dict(zip(raw_cols, standard_names(raw_cols) if rename else raw_cols))
    named = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])

    def typed(prof):
        prof = prof.withColumn("_raw", F.col("variable")).withColumn("variable", F.element_at(named, F.col("variable")))
        return profile.semantic_type(prof).select("_raw", "type", "filled").collect()

    if exact:
        # the distinct values are counted once; markers only move cells to the missing ones
        raw_counts = settle(profile.value_counts(df.withColumns(loads), raw_cols, row_id))
        n, value = F.col("n"), F.col("value")
        lines = raw_counts.groupBy("variable").agg(F.sum("n").alias("rows"), F.sum(F.when(value.isNull(), n).otherwise(0)).alias("missing"),
                                                   F.sum(F.when(value.isNotNull() & null_markers(value).isNull(), n).otherwise(0)).alias("marked")).collect()
        marks = {"rows": max((r["rows"] for r in lines), default=0), "missing": sum(r["missing"] for r in lines), "marker_missing": sum(r["marked"] for r in lines)}
        counts = raw_counts.withColumn("value", null_markers(value)).groupBy("variable", "value").agg(
            F.sum("n").alias("n"), F.min("first_row").alias("first_row"))
        found = typed(profile.profile(counts))
    else:
        found = typed(profile.fast_profile(solid, raw_cols, row_id))
        marks = marker_counts(df, raw_cols).first().asDict()
        marks["missing"] = marks["raw_missing"] + marks["load_missing"]
    rows_in = marks["rows"]
    empty = all(r["filled"] == 0 for r in found)
    blank_cols = [] if empty else [r["_raw"] for r in found if r["filled"] == 0]
    kept = [c for c in raw_cols if c not in blank_cols]
    kinds = dict.fromkeys(kept, "empty") | {r["_raw"]: r["type"] for r in found if r["filled"] > 0}
    types = {names[c]: kinds[c] for c in kept}
    tally = {k: list(types.values()).count(k) for k in sorted(set(types.values()))}
    phys = dict(solid.dtypes)
    cols = [names[c] for c in kept]
    by_kind = {k: [c for c in cols if types[c] == k] for k in set(types.values())}
    dates = by_kind.get("date", [])
    numbers = [c for c in cols if types[c] in ("numeric", "ordinal")]
    categories = by_kind.get("categorical", [])
    converted = solid.select(row_id, *[convert_cell(c, kinds[c], phys[c]).alias(names[c]) for c in kept])

    report_only = duplicate_strategy == "report"
    if report_only:
        unique = dedup.flag_duplicates(converted, cols, row_id)
        aggs = [F.count("*").alias("rows"), F.count("*").alias("solid"), F.count_if("_duplicate_flag").alias("flagged")]
    else:
        unique = dedup.drop_duplicates(converted, cols, row_id, duplicate_strategy, "_copies")
        aggs = [F.count("*").alias("rows"), F.coalesce(F.sum("_copies"), F.lit(0)).alias("solid")]
    measured = Observation()
    for i, c in enumerate(cols):
        text = F.col(c).cast("string")
        aggs += [F.count(c).alias(f"held{i}"), F.min_by(text, F.when(text.isNotNull(), F.col(row_id))).alias(f"first{i}")]
    types_now = dict(converted.dtypes)
    for i, c in enumerate(numbers):
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        if types_now[c] == "string":
            x = parse_number(F.col(c))
        aggs += [F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}"), F.avg(x).alias(f"avg{i}"), F.stddev_samp(x).alias(f"sd{i}")]
    # counted where the rows are written, so a task that runs again counts once
    data = settle(unique.observe(measured, *aggs)).drop("_copies")
    got = measured.get
    rows_out, rows_solid = got["rows"], got["solid"]
    log.append(("ok", "Whitespace stripped", "Column names + string cells cleaned"))
    log.append(("ok", "Null markers standardised", f"{marks['marker_missing']} additional nulls identified"))
    if rows_in > rows_solid:
        log.append(("warn", "Blank rows removed", f"{rows_in - rows_solid} empty rows dropped"))
    if blank_cols:
        log.append(("warn", "Blank columns removed", f"{len(blank_cols)} empty columns dropped"))
    if rows_in == rows_solid and not blank_cols:
        log.append(("ok", "Blank check", "No blank rows/columns detected"))
    log.append(("ok", "Column names sanitised", f"{len(raw_cols)} columns cleaned"))
    renamed = sum(1 for k, v in names.items() if k != v)
    if renamed:
        log.append(("ok", "Column names standardised", f"Renamed {renamed} columns"))
    log.append(("ok", "Column types detected", ", ".join(f"{k}:{v}" for k, v in tally.items())))
    log.append(("ok", "Categories standardised", f"{len(categories)} columns → Title Case"))
    log.append(("ok", "Dates standardised", f"{len(dates)} date columns → YYYY-MM-DD"))
    log.append(("ok", "Currency / numerics parsed", f"{len(numbers)} columns parsed → float"))
    held = {c: got[f"held{i}"] for i, c in enumerate(cols)}
    figures = {c: tuple(got[f"{f}{i}"] for f in ("min", "max", "avg", "sd")) for i, c in enumerate(numbers)}
    if report_only:
        if got["flagged"]:
            log.append(("warn", "Duplicate report", f"{got['flagged']} rows are duplicates (kept, flagged)"))
        else:
            data = data.drop("_duplicate_flag")
    elif rows_out < rows_solid:
        log.append(("warn", "Duplicate rows removed", f"{rows_solid - rows_out} duplicates dropped (strategy: {duplicate_strategy})"))
    if rows_out == rows_solid and not any(s.startswith("Duplicate") for _, s, _ in log):
        log.append(("ok", "Duplicate check", "No duplicate rows found"))

    quartiles = {}
    if numbers and (outlier_method != "zscore" or impute_strategy == "median"):
        quartiles = {r["variable"]: r["q"] for r in ranks.quantiles(outliers.numeric(data, numbers), numbers, [0.25, 0.5, 0.75]).collect()}
    limits = {}
    for c in numbers:
        if outlier_method == "zscore":
            mid, spread = figures[c][2], figures[c][3]
            low, high = (mid - outlier_factor * spread, mid + outlier_factor * spread) if spread else (None, None)
        else:
            q1, _, q3 = quartiles[c] or (0.0, 0.0, 0.0)
            spread = q3 - q1
            low, high = q1 - outlier_factor * spread, q3 + outlier_factor * spread
        if spread and held[c] >= outliers.MIN_VALUES:
            limits[c] = (low, high)
    beyond = Observation()
    report = outliers.rows_beyond(data, limits, row_id)
    report = settle(report.observe(beyond, *[F.count_if(F.col("variable") == c).alias(f"n{i}") for i, c in enumerate(cols)]))
    n_by_col = {c: beyond.get[f"n{i}"] for i, c in enumerate(cols) if beyond.get[f"n{i}"]}
    outlier_n = literal_rows(spark, sorted(n_by_col.items()), "variable string, outliers long")
    if n_by_col:
        log.append(("warn", "Outliers flagged",
                    "; ".join(f"{c}: {n_by_col[c]} outlier(s) ({outlier_method})" for c in cols if c in n_by_col)))
    else:
        log.append(("ok", "Outlier check", "No statistical outliers detected"))

    if impute_strategy == "leave":
        log.append(("ok", "Missing value check", "Imputation skipped (strategy = 'leave')"))
    gaps = [c for c in numbers + categories if held[c] < rows_out] if impute_strategy != "leave" else []
    fill_num, fill_cat = [c for c in numbers if c in gaps], [c for c in categories if c in gaps]
    filled: dict[str, object] = {}
    if gaps:
        if impute_strategy == "median":
            filled = {c: quartiles[c][1] if quartiles[c] else None for c in fill_num}
        elif impute_strategy == "mean":
            filled = {c: figures[c][2] for c in fill_num}
        modes = fill_cat + ([] if filled else fill_num)
        if modes:
            for r in outliers.fill_values(data, [c for c in modes if c in fill_num], fill_cat, "mode").collect():
                filled[r["variable"]] = r["fill_text"] if r["variable"] in fill_cat else r["fill_number"]
        texts = []
        for c in [c for c in cols if c in gaps]:
            if filled[c] is None:
                log.append(("warn", "Missing values", f"Column '{c}' is 100% missing — cannot impute"))
            else:
                texts.append(f"{c}(mode='{filled[c]}')" if c in fill_cat else f"{c}({impute_strategy}={filled[c]:.2f})")
        filled = {c: v for c, v in filled.items() if v is not None}
        data = data.na.fill(filled) if filled else data
        log.append(("ok", "Missing values imputed", f"strategy={impute_strategy} → " + "; ".join(texts[:3])))
        if len(texts) > 3:
            log.append(("ok", "...", f"And {len(texts) - 3} more columns"))
    elif impute_strategy != "leave":
        log.append(("ok", "Missing value check", "No imputation needed"))

    if exact:
        mixed = profile.mixed_columns(raw_counts)
    else:
        mixed = profile.fast_profile(df.withColumns(loads), raw_cols, row_id).where(profile.is_mixed()).select(
            "variable", "numeric_cells", "filled", F.col("first_offender").alias("samples"))
    # at most one row per column
    offenders = [(names[r["variable"]], r["numeric_cells"], r["filled"], r["samples"]) for r in mixed.collect()]
    mixed = literal_rows(spark, offenders, "variable string, numeric_cells long, filled long, samples string")
    mixed_names = [r[0] for r in offenders]
    type_rows = literal_rows(spark, [(c, types[c], c in mixed_names) for c in cols],
                                      "variable string, type string, mixed boolean")
    after = {c: 0 if c in filled else rows_out - held[c] for c in cols}
    if exact:
        raw_of = {v: k for k, v in names.items()}
        stored = dict(data.dtypes)
        told = {raw_of[c]: F.lit(v).cast(stored[c]).cast("string") for c, v in filled.items()}
        distinct = _distinct_after(counts, {c: kinds[c] for c in kept}, phys, told)
        stats_rows = []
        for i, c in enumerate(cols):
            low, high, mean, _ = figures.get(c, (None,) * 4)
            if c in filled and c in numbers:
                mean = (mean * held[c] + filled[c] * (rows_out - held[c])) / rows_out
            stats_rows.append((c, rows_out, after[c], distinct.get(raw_of[c], 0), low, high, mean, got[f"first{i}"]))
        measures = literal_rows(spark, stats_rows, "variable string, rows long, missing long, distinct long, min double, max double, mean double, first_value string")
        top = profile.top_values(profile.value_counts(data, categories, row_id), []) if categories else measures.select("variable", F.lit("").alias("top")).limit(0)
        summary = profile.summary_rows(measures, top, type_rows, [])
    else:
        summary = profile.fast_summary(data, cols, row_id, type_rows, categories)
    lines = [tuple(r) for r in summary.collect()]
    summary = literal_rows(spark, lines, "variable string, type string, mixed boolean, missing long, missing_percent double, distinct long, sample string")
    log.append(("ok", "Column summary generated", f"{len(cols)} columns"))
    missing_after = sum(after.values())
    bad_dates = sum(after[c] for c in dates)
    one = literal_rows(spark, [(1,)], "one int").select(quality_score(*[F.lit(v) for v in (
        rows_out * len(cols), missing_after, rows_out, sum(n_by_col.values()), bad_dates, rows_out * len(dates),
        rows_in - rows_out, rows_in, len(mixed_names), len(cols))]).alias("score"))
    score = one.first()["score"]
    log.append(("ok", "Data quality scored", f"Overall Data Quality: {score}%"))
    stats = {"rows_in": rows_in, "cols_in": len(raw_cols), "rows_out": rows_out, "cols_out": len(data.columns) - 1,
             "rows_removed": rows_in - rows_out, "missing_before": marks["missing"],
             "missing_after": missing_after, "impute_strategy": impute_strategy,
             "duplicate_strategy": duplicate_strategy, "outlier_method": outlier_method,
             "mixed_columns": len(mixed_names), "data_quality_score": score}
    advice = recommendations(summary, mixed, outlier_n, rows_in - rows_out, outlier_method, duplicate_strategy)
    tables = {
        "cleaned_data": data, "column_summary": summary, "outlier_report": report, "mixed_columns": mixed,
        "recommendations": advice.orderBy("kind", "variable").select("advice"),
        "cleaning_log": literal_rows(spark, log, "level string, stage string, detail string"),
        "run_stats": literal_rows(spark, [(k, str(v)) for k, v in stats.items()], "metric string, value string"),
    }
    return CleanResult(data, types, log, stats, tables)


def clean_folder_counts(df: DataFrame, columns: list[str], row_id: str = ROW_ID) -> DataFrame:
    """Folder batch: one profile per source file from a single job, the file being one more group key."""
    solid = drop_blank_rows(strip_and_null(df, columns), columns)
    counts = profile.value_counts(solid, columns, row_id, [FILE])
    return profile.semantic_type(profile.profile(counts, [FILE]))
