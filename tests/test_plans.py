import pytest
from pyspark.sql import functions as F

from statloom.operators import comparisons, profile
from statloom.plans import cleaning, interpret, study
from statloom.plans.folder import HEADER, clean_folder as clean_files
from statloom.plans.templates import MODES, TEXTS
from statloom.sources import readers, sinks


def survey(spark, n=120):
    """A survey-shaped text table: ids, gaps, currencies, booleans, a hyphenated category."""
    k = F.col("id")
    return spark.range(n).select(
        k.alias("_row_id"), (k + 1001).cast("string").alias("student id"),
        F.when(k % 15 == 3, "N/A").otherwise((k % 18 + 17).cast("string")).alias("age"),
        F.when(k % 2 == 0, " Female").otherwise("male ").alias("sex"),
        F.when(k % 24 == 5, "").otherwise(F.format_string("%.2f", (k % 40) / 10.0)).alias("cgpa"),
        F.format_string("$%,.2f", (k * 531.25 + 8000).cast("double")).alias("income usd"),
        F.when(k % 3 == 0, "No").otherwise("Yes").alias("satisfied"),
        F.when(k % 3 == 1, "part-time").otherwise("FULL-TIME").alias("study mode"),
        F.date_format(F.date_add(F.lit("2024-01-01"), k.cast("int")), "dd/MM/yyyy").alias("joined"))


def test_clean_survey(spark):
    df = survey(spark)
    extra = df.limit(5).withColumn("_row_id", F.col("_row_id") + 1000)
    blank = df.limit(1).select(F.lit(5000).cast("long").alias("_row_id"), *[F.lit("").alias(c) for c in df.columns[1:]])
    r = cleaning.clean(df.unionByName(extra).unionByName(blank))
    assert r.types == {"student_id": "identifier", "Age": "numeric", "Gender": "categorical", "cgpa": "numeric",
                       "Income": "numeric", "satisfied": "boolean", "study_mode": "categorical", "joined": "date"}
    assert (r.stats["rows_in"], r.stats["rows_out"], r.stats["missing_after"]) == (126, 120, 0)
    assert dict(r.data.dtypes)["joined"] == "date" and dict(r.data.dtypes)["Income"] == "double"
    assert {x["study_mode"] for x in r.data.select("study_mode").distinct().collect()} == {"Part-Time", "Full-Time"}
    stages = [s for _, s, _ in r.log]
    assert stages[0] == "Whitespace stripped" and stages[-1] == "Data quality scored"
    assert "Blank rows removed" in stages and "Duplicate rows removed" in stages
    again = cleaning.clean(r.data, rename=False)
    assert again.stats["rows_removed"] == 0 and again.stats["missing_after"] == 0
    rows = lambda d: sorted(map(str, d.select(sorted(d.columns)).collect()))
    assert rows(again.data) == rows(r.data)


def test_clean_by_sketch_gives_the_same_cells(spark):
    df = survey(spark, 80)
    a, b = cleaning.clean(df), cleaning.clean(df, exact=False)
    assert a.types == b.types and a.stats == b.stats
    assert sorted(map(str, a.data.collect())) == sorted(map(str, b.data.collect()))
    rows = lambda r: sorted(map(str, r.tables["column_summary"].collect()))
    assert rows(a) == rows(b)


def test_result_sheet(spark):
    done = study.run_test(table(spark), "t_test", {"numeric_var": "score", "group_var": "arm"})
    sheet = {r["metric"]: r["value"] for r in study.result_sheet(done).collect()}
    assert sheet["Analysis"] == "Independent Samples T-Test" and sheet["Effect Size"].startswith("Cohen's d = ")


def test_clean_report_and_leave(spark):
    df = survey(spark, 60)
    both = df.unionByName(df.limit(4).withColumn("_row_id", F.col("_row_id") + 1000))
    r = cleaning.clean(both, duplicate_strategy="report", impute_strategy="leave", outlier_method="zscore")
    assert r.stats["rows_out"] == 64 and r.data.where("_duplicate_flag").count() == 8
    assert r.stats["missing_after"] > 0
    assert ("ok", "Missing value check", "Imputation skipped (strategy = 'leave')") in r.log


def test_written_tables(spark, tmp_path):
    r = cleaning.clean(survey(spark, 40))
    sinks.write_tables(r.tables, str(tmp_path / "out"), "csv")
    back = spark.read.option("header", True).csv(str(tmp_path / "out" / "cleaned_data"))
    assert back.count() == 40 and back.where("joined = '2024-01-01'").count() == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "cleaning_log")).count() == len(r.log)


def test_csv_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,N/A\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,name\n3,y\n", encoding="utf-8")
    df = readers.read_csv(spark, str(tmp_path))
    assert readers.data_columns(df) == ["id", "name"] and df.count() == 3
    assert df.select(readers.FILE).distinct().count() == 2
    types = cleaning.clean_folder_counts(df, ["id", "name"]).collect()
    assert len(types) == 4 and {t["type"] for t in types if t["variable"] == "id"} == {"identifier"}
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "c.csv").write_bytes("name\ncaf\xe9\n".encode("latin-1"))
    assert readers.read_csv(spark, str(tmp_path / "l")).first()["name"] == "café"


def test_csv_files_of_different_make(spark, tmp_path):
    """Encodings, column orders, missing columns, quoted line breaks and a byte-order mark, file by file."""
    (tmp_path / "a.csv").write_bytes('\ufeffid,name,note\n1,José,"line one\nline two"\n2,x,"a, ""b"""\n'.encode("utf-8"))
    (tmp_path / "b.csv").write_bytes("name,id\nJosé,3\nz,4\nw,5\n".encode("latin-1"))
    (tmp_path / "c.csv").write_text("id,extra\n6,e\n", encoding="utf-8")
    rows = readers.read_csv(spark, str(tmp_path)).orderBy(readers.ROW_ID).collect()
    assert [(r["id"], r["name"], r["note"], r["extra"]) for r in rows] == [
        ("1", "José", "line one\nline two", None), ("2", "x", 'a, "b"', None), ("3", "José", None, None), ("4", "z", None, None),
        ("5", "w", None, None), ("6", None, None, "e")]


def test_folder_equals_single_runs(spark, tmp_path):
    """Cells, log, figures, summaries and advice of every file are those of a run over that file alone."""
    for name in ("x", "y", "z"):
        (tmp_path / "in" / name).mkdir(parents=True)
    head = "student id,age,sex,price.usd,joined,code\n"
    rows = [f"{i + 1},{'N/A' if i % 11 == 3 else i % 18 + 17},{' Female' if i % 2 else 'male '},\"${i * 531 + 8000:,}.50\",{i % 28 + 1:02d}/0{i % 9 + 1}/2024,{'abc' if i % 7 == 0 else i}" for i in range(60)]
    (tmp_path / "in" / "x" / "a.csv").write_text(head + "\n".join(rows + rows[:3] + [",,,,,"]) + "\n")
    (tmp_path / "in" / "y" / "a.csv").write_text("code,Sex,empty\n" + "\n".join(f"{v},{s}," for v, s in zip([5, 6, 7, 8, 5, 9, 4000, 6, 7, 8], ["m", "f", "", "m", "m", "f", "?", "m", "f", "m"])) + "\n")
    (tmp_path / "in" / "z" / "b.csv").write_text("text\n" + "\n".join(f"word {i}" for i in range(40)) + "\n")
    paths = [str(tmp_path / "in" / n) for n in ("x", "y", "z")]
    other = {"duplicate_strategy": "report", "impute_strategy": "mean", "outlier_method": "zscore", "outlier_factor": 2.0}
    for n, (options, alone_too) in enumerate((({}, (0, 1)), (other, (1, 2)))):
        out = f"{tmp_path}/out{n}"
        found = clean_files(readers.read_csv(spark, paths, header=HEADER), out, **options).collect()
        assert [r["file"].rsplit("/", 2)[1:] for r in found] == [["x", "a.csv"], ["y", "a.csv"], ["z", "b.csv"]]
        for r, path in ((found[i], paths[i]) for i in alone_too):
            alone = cleaning.clean(readers.read_csv(spark, path), **options)
            here = {t: spark.read.parquet(f"{out}/{t}").where(F.col("_file") == r["file"]).drop("_file") for t in alone.tables}
            assert (r["rows"], r["quality_score"]) == (alone.stats["rows_out"], alone.stats["data_quality_score"])
            cells = lambda d, own: sorted(tuple(_text(x[c]) for c in own) for x in d.collect())
            own = [c for c in alone.data.columns if c != "_row_id"]
            assert cells(here["cleaned_data"], own) == cells(alone.data, own)
            assert [tuple(x)[1:] for x in here["cleaning_log"].orderBy("position").collect()] == alone.log
            for t, keys in (("run_stats", ["metric", "value"]), ("column_summary", alone.tables["column_summary"].columns), ("mixed_columns", ["variable", "samples"]), ("recommendations", ["advice"]),
                            ("outlier_report", ["variable", "value"])):
                assert cells(here[t], keys) == cells(alone.tables[t], keys), t


def _text(v):
    try:
        return f"{float(v):.6g}"
    except (TypeError, ValueError):
        return str(v)


def test_number_of_jobs_does_not_grow_with_files(spark, tmp_path):
    def jobs(files):
        folder = tmp_path / f"in{files}"
        folder.mkdir()
        for i in range(files):
            (folder / f"f{i}.csv").write_text("id,v\n" + "".join(f"{j},{j * i % 7}\n" for j in range(20)))
        tracker, group = spark.sparkContext.statusTracker(), f"files-{files}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            got = clean_files(readers.read_csv(spark, str(folder)), f"{tmp_path}/out{files}")
            assert got.count() == files
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(group))

    assert jobs(40) <= jobs(4) + 10


def test_clean_folder(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,day\n" + "".join(f"{i},2024-01-{i % 28 + 1:02d}\n" for i in range(40)), encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,price\n" + "".join(f"{i},${i}.50\n" for i in range(30)), encoding="utf-8")
    got = clean_files(readers.read_csv(spark, str(tmp_path)), str(tmp_path / "out"), rename=False).collect()
    assert [(r["file"].rsplit("/", 1)[1], r["rows"], r["columns"]) for r in got] == [("a.csv", 40, 2), ("b.csv", 30, 2)]
    assert dict(spark.read.parquet(str(tmp_path / "out" / "cleaned_data")).dtypes)["price"] == "double"
    assert spark.read.parquet(str(tmp_path / "out" / "cleaning_log")).where("_file LIKE '%a.csv'").count() > 3
    clean_files(readers.read_csv(spark, str(tmp_path / "*.csv")), str(tmp_path / "csv"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "cleaned_data")).count() == 70


def test_shared_folder_or_error():
    from statloom import session

    class Fake:
        class conf:  # noqa: N801
            values = {"spark.master": "spark://host:7077"}

            @classmethod
            def get(cls, key, default=None):
                return cls.values.get(key, default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Fake)
    Fake.conf.values = {"spark.master": "local[4]", "spark.sql.warehouse.dir": "file:/w"}
    assert session.checkpoint_folder(Fake) == "file:/w/_settled"


def test_gate(spark):
    counts = spark.createDataFrame([("a", 10, 100), ("b", 200000, 100), ("c", 1, 90 << 20)], "file string, rows long, bytes long")
    out = {r["file"]: (r["ok"], r["reason"]) for r in readers.gate(counts, 5).collect()}
    assert out["a"] == (True, None)
    assert "200,000 rows" in out["b"][1] and "90.0 MB" in out["c"][1]
    assert "300 columns" in readers.gate(counts.limit(1), 300).first()["reason"]


def test_extract_variables(spark):
    rows = [('{"numeric_var":"x","group_var":"g","columns":["x","y"]}',), ('{"dependent":"","predictors":[]}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(sinks.extract_variables(F.col("p"))).collect()]
    assert got == [["x", "g", "y"], []]


def table(spark, n=300):
    k = F.col("id")
    return spark.range(n).select(
        k, (k % 37 * 1.0).alias("score"), (k % 37 * 2.0 + k % 5).alias("hours"), (k % 11 * 3.0).alias("wealth"),
        F.when(k % 2 == 0, "a").otherwise("b").alias("arm"), (F.concat(F.lit("s"), (k % 3).cast("string"))).alias("site"),
        (k % 5 + 1).alias("q1"), ((k + k % 2) % 5 + 1).alias("q2"))


COLS = ["score", "hours", "wealth", "arm", "site", "q1", "q2"]


def test_suggestions(spark):
    meta = study.column_metadata(table(spark), COLS).collect()
    s = study.suggest(meta)
    assert s["t_test"] == {"numeric_var": "score", "group_var": "arm"}
    assert s["anova"]["group_var"] == "site"
    assert s["reliability"]["columns"] == ["wealth", "q1", "q2"]
    assert s["regression"] == {"dependent": "score", "predictors": ["hours", "wealth"]}
    assert study.is_id_name("student-id") and not study.is_id_name("notes")
    tests = [r["test"] for r in study.recommend(study.column_metadata(table(spark), COLS)).collect()]
    assert tests == ["descriptive", "chi_square", "correlation", "t_test", "anova", "regression", "mann_whitney"]


def test_study(spark, tmp_path):
    df = table(spark)
    config = study.suggest(study.column_metadata(df, COLS).collect())
    assert study.validate(df, config, ["id"]).where("kind = 'structural'").count() == 0
    out = study.run_study(df, config, ["id"], min_score=0.8, folder=str(tmp_path / "study"))
    assert set(out.results) | set(out.skipped) == set(config) and not out.errors
    assert out.counts()["total_count"] == 7
    assert spark.read.parquet(str(tmp_path / "study" / "descriptive" / "numeric_summary")).count() == 5
    sections = study.report_sections(spark, out)
    assert sections.where("section > 0").count() == len(out.results)


def test_study_problems(spark):
    df = table(spark)
    config = {"t_test": {"numeric_var": "score", "group_var": "site"}, "regression": {"dependent": "score", "predictors": ["score"]}}
    rows = {r["test"]: r["message"] for r in study.validate(df, config, ["id"]).where("kind = 'structural'").collect()}
    assert rows["t_test"] == "'site' must have exactly 2 groups." and "predictor" in rows["regression"]
    assert rows["descriptive"] == "No variables selected for this test."
    assert study.run_test(df, "unknown", {}).error == "Unknown: unknown"
    assert study.run_test(df, "correlation", {"columns": ["arm", "score"]}).error == "Need ≥2 numeric columns."


def test_every_text_renders(spark):
    df = table(spark)
    runs = {"chi_square": {"var1": "arm", "var2": "site"}, "t_test": {"numeric_var": "score", "group_var": "arm"},
            "anova": {"numeric_var": "score", "group_var": "site"}, "mann_whitney": {"numeric_var": "score", "group_var": "arm"},
            "kruskal_wallis": {"numeric_var": "score", "group_var": "site"},
            "regression": {"dependent": "score", "predictors": ["hours", "wealth"]},
            "correlation": {"columns": ["score", "hours", "wealth"]}, "descriptive": {"columns": ["score", "hours"]}}
    for test, params in runs.items():
        summary = study.run_test(df, test, params).tables["summary"]
        texts = interpret.interpret(summary, test, params).collect()
        assert [t["mode"] for t in texts] == MODES and all(t["text"] and "{" not in t["text"] for t in texts)
        assert summary.first()["apa_citation"]
    assert {m for _, m in TEXTS} == set(MODES)


def test_texts_by_example(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", 3.0), ("y", 7.0), ("y", 8.0), ("y", 9.0)], "g string, v double")
    row = comparisons.t_test(df, "v", "g")
    assert row.select(interpret.citation("t_test")).first()[0] == "t(4.00)=-7.35, p = 0.002, d=-6.00, 95% CI [-8.27,-3.73]"
    simple = interpret.interpret(row, "t_test", {}, modes=["executive"]).first()["text"]
    assert simple == ("A significant difference was found between x (M=2.0) and y (M=8.0) (p = 0.002). "
                      "The effect size is large (d=-6.0).")
    assert [r[0] for r in spark.createDataFrame([(0.5,), (3.0,), (-0.00004,), (1234.56789,)], "v double").select(
        interpret.num_text(F.col("v"))).collect()] == ["0.5", "3.0", "-0.0", "1234.5679"]


def test_sketched_cleaning_of_one_file_runs_on_all_cores(spark, tmp_path, monkeypatch):
    """Scans that shuffle nothing have as many tasks as the input: one small file must not be one task."""
    path = str(tmp_path / "one")
    survey(spark).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path).withColumn("none", F.lit(None))
    tasks, scan = [], profile.fast_profile
    monkeypatch.setattr(profile, "fast_profile", lambda rows, *a: tasks.append(rows.rdd.getNumPartitions()) or scan(rows, *a))
    r = cleaning.clean(df, impute_strategy="leave", rename=False, exact=False)
    assert df.rdd.getNumPartitions() == 1 and len(tasks) == 2 and min(tasks) >= 4
    want = cleaning.clean(spark.read.parquet(path), impute_strategy="leave", rename=False)
    assert sorted(r.data.collect()) == sorted(want.data.collect()) and r.types == want.types
