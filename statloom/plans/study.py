"""Named tests, test recommendation, and the packaged study: suggest, validate, gate, run, report."""

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.functions.scalars import effect_text, strip_markdown
from statloom.operators import assumptions, comparisons, correlation, crosstab, profile, regression, summaries
from statloom.plans import interpret
from statloom.session import literal_rows

ALWAYS_SOUND = ("descriptive",)


@dataclass
class TestResult:
    """Result tables of one test; `summary` holds the headline row."""

    __test__ = False
    test: str
    params: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)
    error: str | None = None


# --- named tests ------------------------------------------------------------

def _cited(df: DataFrame, test: str, params: dict) -> DataFrame:
    return df.withColumn("apa_citation", interpret.citation(test)).withColumn(
        "interpretation", interpret.sentence(test, params))


def run_descriptive(df, columns):
    num, cat = summaries.split_numeric(df, columns)
    tables = {}
    if num:
        tables["numeric_summary"] = summaries.describe(df, num, normality=True)
        tables["summary"] = interpret.highlights(tables["numeric_summary"], num).withColumn(
            "apa_citation", interpret.citation("descriptive"))
    if cat:
        tables["categorical_summary"] = summaries.frequencies(df, cat)
    return tables


def run_chi_square(df, var1, var2):
    params = {"var1": var1, "var2": var2}
    return {"summary": _cited(crosstab.chi_square(df, var1, var2), "chi_square", params),
            "contingency_table": crosstab.with_margins(df, var1, var2),
            "expected_table": crosstab.expected_table(df, var1, var2),
            "residuals": crosstab.residuals(df, var1, var2)}


def run_t_test(df, numeric_var, group_var, alpha=0.05):
    row = _cited(comparisons.t_test(df, numeric_var, group_var, alpha=alpha), "t_test", {"numeric_var": numeric_var})
    lev = comparisons.levene(df, numeric_var, group_var).select("levene_p").scalar()
    return {"summary": row.withColumn("levene_p", lev),
            "summary_table": summaries.group_summary(df, numeric_var, group_var)}


def run_anova(df, numeric_var, group_var):
    params = {"numeric_var": numeric_var, "group_var": group_var}
    return {"summary": _cited(comparisons.anova(df, numeric_var, group_var), "anova", params),
            "summary_table": summaries.group_summary(df, numeric_var, group_var),
            "posthoc_table": comparisons.pairwise_t(df, numeric_var, group_var)}


def run_correlation(df, columns, method="pearson"):
    num, _ = summaries.split_numeric(df, columns, 0.4)
    if len(num) < 2:
        raise ValueError("Need ≥2 numeric columns.")
    pairs = correlation.spearman(df, num) if method == "spearman" else correlation.pearson(df, num)
    head = interpret.strongest_pair(pairs, method).withColumns(
        {"variables": F.lit(len(num)), "n": pairs.agg(F.max("n")).scalar(), "min_p": pairs.agg(F.min("p_value")).scalar()})
    return {"summary": head.withColumn("apa_citation", interpret.citation("correlation")),
            "pairs_table": pairs.withColumn("note", interpret.pair_note())}


def run_regression(df, dependent, predictors):
    params = {"dependent": dependent, "predictors": predictors}
    return {"summary": _cited(regression.model_summary(df, dependent, predictors), "regression", params),
            "coef_table": regression.coef_table(df, dependent, predictors)}


def run_mann_whitney(df, numeric_var, group_var):
    return {"summary": _cited(comparisons.mann_whitney(df, numeric_var, group_var), "mann_whitney",
                              {"numeric_var": numeric_var})}


def run_kruskal(df, numeric_var, group_var):
    return {"summary": _cited(comparisons.kruskal(df, numeric_var, group_var), "kruskal_wallis",
                              {"numeric_var": numeric_var}),
            "group_medians": summaries.group_medians(df, numeric_var, group_var).join(
                summaries.group_summary(df, numeric_var, group_var).select("grp", F.col("mean").alias("group_mean")),
                "grp")}


def run_reliability(df, columns):
    if len(columns) < 2:
        raise ValueError("Reliability analysis needs at least 2 items and 2 valid rows.")
    return {"summary": _cited(comparisons.reliability(df, columns).withColumn("p_value", F.lit(None).cast("double"))
                              .withColumn("p_display", F.lit("—")), "reliability", {}),
            "item_table": comparisons.item_totals(df, columns)}


TESTS = {
    "descriptive": run_descriptive, "chi_square": run_chi_square, "t_test": run_t_test, "anova": run_anova,
    "correlation": run_correlation, "regression": run_regression, "mann_whitney": run_mann_whitney,
    "kruskal_wallis": run_kruskal, "reliability": run_reliability,
}


def run_test(df: DataFrame, name: str, params: dict) -> TestResult:
    """Build a test's tables; problems come back in `error`, not as an exception."""
    if name not in TESTS:
        return TestResult(name, params, error=f"Unknown: {name}")
    try:
        return TestResult(name, params, TESTS[name](df, **params))
    except Exception as exc:  # a bad column or parameter is an outcome of the study, not a crash
        return TestResult(name, params, error=str(exc))


def result_sheet(result: TestResult) -> DataFrame:
    """Headline of a result as (position, metric, value) rows."""
    summary = result.tables["summary"]
    held = summary.columns

    def text(*names):
        return F.coalesce(*[F.col(n).cast("string") for n in names if n in held], F.lit("—"))

    effects = {k: interpret.num_text(F.col(k)) for k in ("cohens_d", "cramers_v", "eta_squared", "r_squared", "effect_r")
               if k in held}
    effect = effect_text(F.col("effect_size") if not effects and "effect_size" in held else None, **effects)
    rows = [("Analysis", F.lit(fv.STUDY_TESTS.get(result.test, result.test))), ("p-value", text("p_display")),
            ("Significance", text("significance")), ("Effect Size", effect), ("APA Citation", text("apa_citation")),
            ("Interpretation", strip_markdown(text("interpretation")))]
    return summary.select(F.inline(F.array(*[F.struct(
        F.lit(i).alias("position"), F.lit(m).alias("metric"), v.alias("value")) for i, (m, v) in enumerate(rows)])))


# --- recommendation ------------------------------------------------------------

def column_metadata(df: DataFrame, columns: list[str], row_id: str | None = None) -> DataFrame:
    """(position, name, dtype, n_unique, numeric_share) per column, from one value-count frame."""
    key = row_id or "_row"
    rows = df if row_id else df.withColumn(key, F.lit(0).cast("long"))
    prof = profile.profile(profile.value_counts(rows, columns, key))
    at = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("variable"))
    kind = F.when(F.col("numeric_cells") > F.col("rows") * 0.5, "numeric").otherwise("categorical")
    return prof.select(at.alias("position"), F.col("variable").alias("name"), kind.alias("dtype"),
                       F.col("distinct").alias("n_unique"),
                       (F.col("numeric_cells") / F.col("rows")).alias("numeric_share"),
                       F.col("distinct_numbers").alias("n_numbers"))


def recommend(meta: DataFrame) -> DataFrame:
    """Suggested tests by column mix, most basic first."""
    def names(hit):
        found = F.collect_list(F.when(hit, F.struct("position", "name")))
        return F.transform(F.sort_array(found), lambda x: x["name"])

    is_num = F.col("dtype") == "numeric"
    cat = ~is_num | (F.col("n_unique") <= 10)
    lists = meta.agg(names(is_num & (F.col("n_unique") > 5)).alias("num"), names(cat).alias("cat"),
                     names(cat & (F.col("n_unique") == 2)).alias("two"),
                     names(cat & (F.col("n_unique") >= 3)).alias("many"))

    def size(c):
        return F.size(c)

    def at(c, i=0):
        return F.get(F.col(c), F.lit(i))

    def row(hit, test, priority, *reason):
        text = F.concat(*[F.lit(r) if isinstance(r, str) else r for r in reason])
        return F.when(hit, F.struct(F.lit(test).alias("test"), F.lit(priority).alias("priority"), text.alias("reason")))

    rows = [
        row(size("num") >= 1, "descriptive", 1,
            "Summarise your numeric variables with mean, SD, skewness and distribution charts."),
        row(size("cat") >= 2, "chi_square", 2, "Test association between categorical variables (e.g. ", at("cat"), " × ",
            at("cat", 1), ")."),
        row((size("num") >= 1) & (size("two") >= 1), "t_test", 2, "Compare ", at("num"), " between two groups in ",
            at("two"), "."),
        row((size("num") >= 1) & (size("many") >= 1), "anova", 3, "Compare ", at("num"), " across 3+ groups in ",
            at("many"), "."),
        row(size("num") >= 2, "correlation", 2, "Explore relationships between numeric variables (",
            F.array_join(F.slice("num", 1, 3), ", "), ")."),
        row(size("num") >= 2, "regression", 3, "Predict ", at("num"), " from other numeric variables."),
        row((size("num") >= 1) & (size("two") >= 1), "mann_whitney", 4,
            "Non-parametric alternative if normality assumption is violated."),
    ]
    return lists.select(F.inline(F.array_compact(F.array(*rows)))).orderBy("priority", "test")


# --- packaged study ------------------------------------------------------------

def is_id_name(name: str) -> bool:
    return any(w in fv.STUDY_IDENTIFIER_TOKENS for w in name.lower().replace("_", " ").replace("-", " ").split())


def suggest(meta_rows: list) -> dict[str, dict | None]:
    """A first choice of variables for every test of the study, None where the columns do not allow one.

    `meta_rows` are the collected rows of `column_metadata`, one per column.
    """
    rows = sorted(meta_rows, key=lambda r: r["position"])
    num = [r["name"] for r in rows if r["dtype"] == "numeric"]
    cat = [r for r in rows if r["dtype"] == "categorical"]
    use = [n for n in num if not is_id_name(n)] or num
    names = [r["name"] for r in cat]
    two = [r["name"] for r in cat if r["n_unique"] == 2]
    many = [r["name"] for r in cat if r["n_unique"] >= 3]
    varied = [r["name"] for r in cat if r["n_unique"] >= 2]
    scales = [r["name"] for r in rows if r["numeric_share"] > 0.9 and 3 <= r["n_numbers"] <= 11]
    described = use[:6] + names[:2]
    return {
        "descriptive": {"columns": described} if described else None,
        "chi_square": {"var1": varied[0], "var2": varied[1]} if len(varied) >= 2 else None,
        "t_test": {"numeric_var": use[0], "group_var": two[0]} if use and two else None,
        "anova": {"numeric_var": use[0], "group_var": many[0]} if use and many else None,
        "correlation": {"columns": use[:6], "method": "pearson"} if len(use) >= 2 else None,
        "regression": {"dependent": use[0], "predictors": use[1:3]} if len(use) >= 2 else None,
        "reliability": {"columns": scales[:8]} if len(scales) >= 2 else None,
    }


def structural_error(test: str, params: dict | None, levels: dict[str, int]) -> str | None:
    """What keeps a test from running at all; `levels` holds distinct counts of columns."""
    if not params:
        return "No variables selected for this test."
    value, group = params.get("numeric_var"), params.get("group_var")
    if test == "descriptive" and not params.get("columns"):
        return "Select at least 1 column."
    if test == "chi_square":
        if not params.get("var1") or not params.get("var2"):
            return "Select two categorical variables."
        if params["var1"] == params["var2"]:
            return "The two variables must be different."
    if test in ("t_test", "anova"):
        if not value or not group:
            return "Select a numeric variable and a grouping variable."
        if test == "t_test" and levels.get(group, 2) != 2:
            return f"'{group}' must have exactly 2 groups."
        if test == "anova" and levels.get(group, 3) < 3:
            return f"'{group}' must have 3+ groups."
    if test == "correlation" and len(params.get("columns", [])) < 2:
        return "Select at least 2 numeric columns."
    if test == "regression":
        if not params.get("dependent") or not params.get("predictors"):
            return "Select a dependent variable and at least 1 predictor."
        if params["dependent"] in params["predictors"]:
            return "Dependent variable cannot also be a predictor."
    if test == "reliability" and len(params.get("columns", [])) < 2:
        return "Select at least 2 scale items."
    return None


def _columns_of(params: dict) -> set[str]:
    """All columns that the parameters of a test name."""
    out: set[str] = set()
    for key in ("numeric_var", "group_var", "dependent", "predictors", "var1", "var2", "columns"):
        v = params.get(key)
        out |= {v} if isinstance(v, str) else set(v or ())
    return out


def soundness_table(df: DataFrame, config: dict[str, dict], order: list[str],
                    min_score: float = fv.SOUND_SCORE) -> DataFrame:
    """(test, score, passed_count, total_count, sound, recommendation) for every configured test, computed once."""
    spark = df.sparkSession
    checks, free = None, []
    asked = [p["numeric_var"] for t, p in config.items() if p and t in assumptions.GROUP_TESTS and p.get("numeric_var") in df.columns and p.get("group_var")]
    known = assumptions.figures_of(df, list(dict.fromkeys(asked))) if asked else None
    for test, params in config.items():
        if not params:
            continue
        if not _columns_of(params) <= set(df.columns):
            continue  # the test itself tells what is wrong
        part = None if test in ALWAYS_SOUND else assumptions.check_assumptions(df, test, params, order, known)
        if part is None:
            note = ("Descriptive statistics are always valid for any data." if test in ALWAYS_SOUND else
                    "This test is statistically sound for your data (score: 100.0%).")
            free.append((test, 1.0, 0, 0, True, note))
        else:
            checks = part if checks is None else checks.unionByName(part)
    schema = "test string, score double, passed_count long, total_count long, sound boolean, recommendation string"
    out = literal_rows(spark, free, schema)
    if checks is not None:
        out = out.unionByName(assumptions.soundness(assumptions.score(checks), min_score))
    return out


def validate(df: DataFrame, config: dict[str, dict], order: list[str]) -> DataFrame:
    """Errors block the study, soundness findings only warn: (test, label, kind, message)."""
    groups = [p["group_var"] for p in config.values() if p and p.get("group_var")]
    levels = {}
    if groups:
        levels = {g: df.where(F.col(g).isNotNull()).select(g).distinct().count() for g in sorted(set(groups))}
    errors = []
    for test, label in fv.STUDY_TESTS.items():
        problem = structural_error(test, config.get(test), levels)
        if problem:
            errors.append((test, label, "structural", problem))
    bad = {e[0] for e in errors}
    spark = df.sparkSession
    rows = literal_rows(spark, errors, "test string, label string, kind string, message string")
    sound = soundness_table(df, {t: p for t, p in config.items() if t not in bad}, order)
    labels = F.create_map(*[F.lit(x) for kv in fv.STUDY_TESTS.items() for x in kv])
    warn = sound.where("NOT sound").select("test", F.element_at(labels, F.col("test")).alias("label"),
                                           F.lit("soundness").alias("kind"), F.col("recommendation").alias("message"))
    return rows.unionByName(warn)


@dataclass
class StudyResult:
    results: dict[str, TestResult]
    errors: dict[str, str]
    skipped: dict[str, str]
    soundness: dict[str, dict]

    def counts(self) -> dict[str, int]:
        return {"completed_count": len(self.results), "total_count": len(fv.STUDY_TESTS),
                "skipped_count": len(self.skipped), "error_count": len(self.errors)}


def run_study(df: DataFrame, config: dict[str, dict], order: list[str], skip_unsound: bool = True,
              min_score: float = fv.SOUND_SCORE, folder: str | None = None, threads: int = 4) -> StudyResult:
    """Gate every test on its soundness, run the sound ones, and write their tables when a folder is given.

    The soundness rows are one job over the table; tests are independent, so their writes are submitted side by
    side and share the cluster. A test that fails, while it is planned or while a table of it is written, is in `errors`; the others go on.
    """
    sound = {r["test"]: r.asDict() for r in soundness_table(df, config, order, min_score).collect()}
    results, errors, skipped = {}, {}, {}
    for test in fv.STUDY_TESTS:
        params = config.get(test)
        found = sound.get(test)
        if skip_unsound and found and found["score"] < min_score:
            skipped[test] = (f"Statistically unsound (score: {found['score'] * 100:.1f}%, "
                             f"minimum: {min_score * 100:.1f}%)")
            continue
        outcome = run_test(df, test, params or {})
        if outcome.error:
            errors[test] = outcome.error
        else:
            results[test] = outcome
    if folder:
        jobs = [(t, name, table) for t, r in results.items() for name, table in r.tables.items()]

        def write(job):
            try:
                job[2].write.mode("overwrite").parquet(f"{folder}/{job[0]}/{job[1]}")
            except Exception as exc:  # what fails while it runs is an outcome of that test alone
                return job[0], f"{job[1]}: {exc}"
            return job[0], None

        with ThreadPoolExecutor(threads) as pool:
            for test, problem in pool.map(write, jobs):
                if problem:
                    errors.setdefault(test, problem)
                    results.pop(test, None)
    return StudyResult(results, errors, skipped, sound)


def report_sections(spark: SparkSession, study: StudyResult) -> DataFrame:
    """Section list of the combined report: soundness lines first, then each completed test in study order."""
    rows = [(0, 1, t, f"{fv.STUDY_TESTS[t]}: {why}") for t, why in study.skipped.items()]
    rows += [(0, 2, t, f"{fv.STUDY_TESTS[t]}: {s['score'] * 100:.1f}% sound") for t, s in study.soundness.items()
             if t not in study.skipped]
    rows += [(i, 0, t, f"{i}. {fv.STUDY_TESTS[t]}") for i, t in enumerate(
        [t for t in fv.STUDY_TESTS if t in study.results], 1)]
    return literal_rows(spark, rows, "section int, line int, test string, text string").orderBy("section", "line", "test")


def combined_report(study: StudyResult) -> DataFrame | None:
    """All result tables of a study as long rows (section, test, table, row), in report order."""
    out = None
    for i, test in enumerate([t for t in fv.STUDY_TESTS if t in study.results], 1):
        for name, table in study.results[test].tables.items():
            part = table.select(F.lit(i).alias("section"), F.lit(test).alias("test"), F.lit(name).alias("table"),
                                F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])).alias("row"))
            out = part if out is None else out.unionByName(part)
    return out
