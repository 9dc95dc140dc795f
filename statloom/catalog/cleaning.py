"""Registered queries: parsing, profiling, duplicates, outliers, imputation, the cleaning plan."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.catalog import views
from statloom.catalog.statistics import rounded
from statloom.catalog.views import table
from statloom.functions import parsing, scalars as sc
from statloom.operators import dedup, outliers, profile, summaries
from statloom.plans import cleaning
from statloom.plans.folder import HEADER, clean_folder as clean_files
from statloom.sources import readers, sinks
from statloom.session import checkpoint_folder, dealt, literal_rows

QUERIES: dict = {}
MESSY = ["raw_balance", "raw_segment", "raw_mode", "raw_mixed", "raw_blank"]


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


_SEGMENT = "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) END"
_BALANCE = "CASE WHEN c_custkey % 6 = 4 THEN NULL ELSE round(c_acctbal, 2) END"
_MODE = "CASE WHEN c_custkey % 3 = 1 THEN 'Part-Time' ELSE 'Full-Time' END"
_MIXED = "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 97 AS DOUBLE) END"


@register("strip_nulls", """SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN lower(c_mktsegment)
  WHEN c_custkey % 4 = 3 THEN concat(upper(substr(c_mktsegment, 1, 1)), lower(substr(c_mktsegment, 2))) ELSE c_mktsegment END
  AS raw_segment, CAST(NULL AS VARCHAR) AS raw_blank FROM customer""")
def strip_nulls(spark, d):
    return cleaning.strip_and_null(views.messy_customer(spark, d), MESSY).select("c_custkey", "raw_segment", "raw_blank")


@register("null_marker_counts", """SELECT CAST(0 AS BIGINT) AS raw_missing,
  CAST(count(*) + count(*) FILTER (c_custkey % 6 = 4) AS BIGINT) AS load_missing,
  CAST(count(*) FILTER (c_custkey % 9 = 0) AS BIGINT) AS marker_missing FROM customer""")
def null_marker_counts(spark, d):
    return cleaning.marker_counts(views.messy_customer(spark, d), MESSY).drop("rows", "blank_rows")


@register("parse_currency", f"SELECT c_custkey, {_BALANCE} AS balance FROM customer")
def parse_currency(spark, d):
    return views.messy_customer(spark, d).select("c_custkey", parsing.parse_number(F.col("raw_balance")).alias("balance"))


@register("parse_dates", """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
  CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""")
def parse_dates(spark, d):
    rows = views.messy_orders(spark, d).where(F.col("_row_id") == F.col("o_orderkey"))
    day = parsing.parse_date(parsing.clean_cell(F.col("raw_date")))
    return rows.select("o_orderkey", day.alias("day")).withColumn("iso", F.date_format("day", "yyyy-MM-dd"))


@register("title_case", f"SELECT c_custkey, {_SEGMENT} AS segment, {_MODE} AS mode FROM customer")
def title_case(spark, d):
    m = cleaning.strip_and_null(views.messy_customer(spark, d), MESSY)
    return m.select("c_custkey", parsing.title_case(F.col("raw_segment")).alias("segment"),
                    parsing.title_case(F.col("raw_mode")).alias("mode"))


@register("log_transform", """SELECT c_custkey, round(ln(c_acctbal + CASE WHEN (SELECT min(c_acctbal) FROM customer) <= 0
  THEN 1 - (SELECT min(c_acctbal) FROM customer) ELSE 0 END), 6) AS c_acctbal_log FROM customer""")
def log_transform(spark, d):
    out = outliers.log_transform(table(spark, d, "customer"), "c_acctbal")
    return out.select("c_custkey", F.round("c_acctbal_log", 6).alias("c_acctbal_log"))


@register("formula_guard", """SELECT p_partkey, CASE WHEN p_partkey % 5 < 4 THEN concat('''', substr('=+-@', CAST(p_partkey % 5 AS INTEGER) + 1, 1), p_name)
  ELSE p_name END AS cell FROM part""")
def formula_guard(spark, d):
    k = F.col("p_partkey") % 5
    sign = F.element_at(F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "")]), (k + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", sc.guard_formula(F.concat(sign, "p_name")).alias("cell"))


@register("strip_markdown", r"""SELECT doc_id, regexp_replace(concat('**', source, '** in **', lang, '**: ', text), '\*\*(.+?)\*\*', '\1', 'g')
  AS note FROM documents""")
def strip_markdown(spark, d):
    marked = F.concat(F.lit("**"), "source", F.lit("** in **"), "lang", F.lit("**: "), "text")
    return table(spark, d, "documents").select("doc_id", sc.strip_markdown(marked).alias("note"))


@register("display_text", "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 THEN 'NaN' ELSE c_mktsegment END AS cell FROM customer")
def display_text(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", sc.display_text(F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment"))).alias("cell"))


@register("blank_rows", """SELECT c_custkey, CASE WHEN c_custkey % 6 <> 4 THEN c_acctbal END AS balance,
  CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment FROM customer WHERE c_custkey % 6 <> 4 OR c_custkey % 9 <> 0""")
def blank_rows(spark, d):
    c = table(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_custkey") % 6 != 4, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_custkey") % 9 != 0, F.col("c_mktsegment")).alias("segment"))
    return cleaning.drop_blank_rows(c, ["balance", "segment"])


@register("complete_rows", "SELECT c_custkey, round(c_acctbal, 2) AS raw_balance, CAST(c_custkey % 97 AS DOUBLE) AS raw_mixed FROM customer "
          "WHERE c_custkey % 6 IN (0, 5) AND c_custkey % 5 <> 0")
def complete_rows(spark, d):
    m = views.messy_customer(spark, d)
    cols = ["raw_balance", "raw_mixed"]
    return summaries.numeric(m, cols).select("c_custkey", *cols).dropna(subset=cols)


def _counts(spark, d):
    m = cleaning.strip_and_null(views.messy_customer(spark, d), MESSY)
    return profile.value_counts(m, MESSY, "c_custkey")


@register("detect_types", """SELECT * FROM (VALUES ('raw_balance', 'numeric'), ('raw_segment', 'categorical'), ('raw_mode', 'categorical'),
  ('raw_mixed', 'numeric'), ('raw_blank', 'empty')) AS t(variable, type), (SELECT count(*) AS rows FROM customer)""")
def detect_types(spark, d):
    return profile.semantic_type(profile.profile(_counts(spark, d))).select("variable", "type", "rows")


@register("detect_types_orders", """SELECT * FROM (VALUES ('o_orderkey', 'numeric'), ('o_custkey', 'numeric'), ('o_orderstatus', 'categorical'),
  ('o_totalprice', 'numeric'), ('raw_date', 'date')) AS t(variable, type)""")
def detect_types_orders(spark, d):
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "raw_date"]
    m = cleaning.strip_and_null(views.messy_orders(spark, d), cols)
    return profile.semantic_type(profile.profile(profile.value_counts(m, cols, "_row_id"))).select("variable", "type")


@register("detect_types_sketch", """SELECT * FROM (VALUES ('raw_balance', 'numeric'), ('raw_segment', 'categorical'), ('raw_mode', 'categorical'),
  ('raw_mixed', 'numeric'), ('raw_blank', 'empty')) AS t(variable, type)""")
def detect_types_sketch(spark, d):
    m = cleaning.strip_and_null(dealt(views.messy_customer(spark, d)), MESSY)
    return profile.semantic_type(profile.fast_profile(m, MESSY, "c_custkey")).select("variable", "type")


@register("mixed_columns", """SELECT 'raw_mixed' AS variable, count(*) FILTER (c_custkey % 5 <> 0) AS numeric_cells, count(*) AS filled,
  'abc' AS samples FROM customer""")
def mixed_columns(spark, d):
    return profile.mixed_columns(_counts(spark, d))


_SUMMARY = f"""WITH v AS (SELECT c_custkey, {_BALANCE} AS balance, {_SEGMENT} AS segment FROM customer),
t AS (SELECT segment, count(*) AS n FROM v WHERE segment IS NOT NULL GROUP BY 1),
top AS (SELECT string_agg(segment, ', ' ORDER BY n DESC, segment) AS top FROM (SELECT * FROM t ORDER BY n DESC, segment LIMIT 3))
SELECT 'balance' AS variable, 'numeric' AS type, count(*) FILTER (balance IS NULL) AS missing,
  round(count(*) FILTER (balance IS NULL) * 100.0 / count(*), 1) AS missing_percent, count(DISTINCT balance) AS "distinct",
  printf('min=%.2f · max=%.2f · mean=%.2f', min(balance), max(balance), avg(balance)) AS sample FROM v
UNION ALL SELECT 'segment', 'categorical', count(*) FILTER (segment IS NULL), round(count(*) FILTER (segment IS NULL) * 100.0 / count(*), 1),
  count(DISTINCT segment), (SELECT concat('Top: ', top) FROM top) FROM v"""


def _clean_customer(spark, d):
    m = cleaning.strip_and_null(views.messy_customer(spark, d), MESSY)
    return m.select("c_custkey", parsing.parse_number(F.col("raw_balance")).alias("balance"),
                    parsing.title_case(F.col("raw_segment")).alias("segment"))


@register("column_summary", _SUMMARY)
def column_summary(spark, d):
    clean = _clean_customer(spark, d)
    counts = profile.value_counts(clean, ["balance", "segment"], "c_custkey")
    types = literal_rows(spark, [("balance", "numeric", False), ("segment", "categorical", False)],
                                  "variable string, type string, mixed boolean")
    return profile.column_summary(counts, types).drop("mixed")


@register("frequent_values", " UNION ALL ".join(f"""SELECT '{c}' AS variable, string_agg(v, ', ' ORDER BY n DESC, v) AS top, true AS decided FROM (
  SELECT CAST({c} AS VARCHAR) AS v, count(*) AS n FROM {t} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)""" for c, t in (("l_returnflag", "lineitem"), ("o_orderpriority", "orders"), ("user_id", "events"))))
def frequent_values(spark, d):
    """The three most frequent values of columns, proposed by a sketch and counted exactly."""
    out = None
    for c, t in (("l_returnflag", "lineitem"), ("o_orderpriority", "orders"), ("user_id", "events")):
        part = profile.frequent_values(table(spark, d, t), [c])
        out = part if out is None else out.unionByName(part)
    return out


@register("quality_score", f"""WITH v AS (SELECT {_BALANCE} AS balance, {_SEGMENT} AS segment FROM customer),
q AS (SELECT quantile_cont(balance, 0.25) AS q1, quantile_cont(balance, 0.75) AS q3 FROM v),
s AS (SELECT count(*) AS n, count(*) FILTER (balance IS NULL) + count(*) FILTER (segment IS NULL) AS missing,
  count(*) FILTER (balance < q1 - 0.5 * (q3 - q1) OR balance > q3 + 0.2 * (q3 - q1)) AS o FROM v, q)
SELECT missing, n AS rows, round(100 - missing / (2.0 * n) * 35, 1) AS score FROM s""")
def quality_score(spark, d):
    c = _clean_customer(spark, d)
    s = c.agg(F.count("*").alias("rows"), (F.count_if(F.col("balance").isNull()) + F.count_if(F.col("segment").isNull()))
              .alias("missing"))
    z = F.lit(0)
    score = cleaning.quality_score(F.col("rows") * 2, F.col("missing"), F.col("rows"), z, z, z, z, F.col("rows"), z, F.lit(2))
    return s.select("missing", "rows", score.alias("score"))


@register("clean_orders_scored", """WITH k AS (SELECT count(*) FILTER (o_orderkey % 10 = 0) AS dup, count(*) AS n,
  count(*) FILTER (o_orderkey % 5 = 4) AS bad FROM orders)
SELECT 'rows_in' AS metric, CAST(n + dup AS VARCHAR) AS value FROM k UNION ALL SELECT 'rows_out', CAST(n AS VARCHAR) FROM k
UNION ALL SELECT 'rows_removed', CAST(dup AS VARCHAR) FROM k UNION ALL SELECT 'cols_in', '5' FROM k
UNION ALL SELECT 'missing_after', CAST(bad AS VARCHAR) FROM k UNION ALL SELECT 'cols_out', '5' FROM k UNION ALL SELECT 'missing_before', '0' FROM k
UNION ALL SELECT 'impute_strategy', 'median' FROM k UNION ALL SELECT 'duplicate_strategy', 'first' FROM k UNION ALL SELECT 'outlier_method', 'iqr' FROM k
UNION ALL SELECT 'mixed_columns', '0' FROM k
UNION ALL SELECT 'data_quality_score', printf('%.1f', round(100 - (bad / (5.0 * n) * 35 + bad / (1.0 * n) * 15 + dup / (1.0 * (n + dup)) * 20), 1)) FROM k""")
def clean_orders_scored(spark, d):
    return cleaning.clean(views.messy_orders(spark, d), rename=False).tables["run_stats"]


@register("clean_customer_table", f"""WITH v AS (SELECT c_custkey, {_BALANCE} AS b, {_SEGMENT} AS s, {_MODE} AS m, {_MIXED} AS x FROM customer),
d AS (SELECT min(c_custkey) AS _row_id, b, s, m, x FROM v GROUP BY b, s, m, x),
f AS (SELECT quantile_cont(b, 0.5) AS fb, quantile_cont(x, 0.5) AS fx FROM d),
g AS (SELECT s AS fs FROM d WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1)
SELECT _row_id, round(coalesce(b, fb), 4) AS raw_balance, coalesce(s, fs) AS raw_segment, m AS raw_mode,
  round(coalesce(x, fx), 4) AS raw_mixed FROM d, f, g""")
def clean_customer_table(spark, d):
    m = views.messy_customer(spark, d).withColumnRenamed("c_custkey", "_row_id")
    return rounded(cleaning.clean(m, rename=False).data, "raw_balance", "raw_mixed")


@register("clean_customer_sketch", f"""SELECT c_custkey AS _row_id, {_BALANCE} AS raw_balance, {_SEGMENT} AS raw_segment, {_MODE} AS raw_mode,
  {_MIXED} AS raw_mixed, CAST(c_custkey AS DOUBLE) AS key FROM customer""")
def clean_customer_sketch(spark, d):
    """The cleaning plan with sketched profiles, nothing imputed; the key keeps every row apart."""
    m = views.messy_customer(spark, d).withColumn("key", F.col("c_custkey").cast("string")).withColumnRenamed("c_custkey", "_row_id")
    return cleaning.clean(m, impute_strategy="leave", rename=False, exact=False).data


_W = fv.QUALITY_WEIGHTS
_LOGGED = [("ok", "Whitespace stripped", "'Column names + string cells cleaned'"), ("ok", "Null markers standardised", "printf('%d additional nulls identified', marks)"),
           ("warn", "Blank columns removed", "'1 empty columns dropped'"), ("ok", "Column names sanitised", "'5 columns cleaned'"),
           ("ok", "Column types detected", "'categorical:2, numeric:2'"), ("ok", "Categories standardised", "'2 columns → Title Case'"),
           ("ok", "Dates standardised", "'0 date columns → YYYY-MM-DD'"), ("ok", "Currency / numerics parsed", "'2 columns parsed → float'"),
           ("warn", "Duplicate rows removed", "printf('%d duplicates dropped (strategy: first)', n - kept)"), ("ok", "Outlier check", "'No statistical outliers detected'"),
           ("ok", "Missing values imputed", "printf('strategy=median → raw_balance(median=%.2f); raw_segment(mode=''%s''); raw_mixed(median=%.2f)', fb, fs, fx)"),
           ("ok", "Column summary generated", "'4 columns'"),
           ("ok", "Data quality scored", f"printf('Overall Data Quality: %.1f%%', round(100 - ((n - kept) / (1.0 * n) * {_W['duplicate']} + 0.25 * {_W['mixed']}), 1))")]


@register("clean_customer_log", f"""WITH v AS (SELECT c_custkey, {_BALANCE} AS b, {_SEGMENT} AS s, {_MODE} AS m, {_MIXED} AS x FROM customer),
d AS (SELECT b, s, m, x FROM v GROUP BY b, s, m, x), f AS (SELECT quantile_cont(b, 0.5) AS fb, quantile_cont(x, 0.5) AS fx, count(*) AS kept FROM d),
g AS (SELECT s AS fs FROM d WHERE s IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 1),
c AS (SELECT count(*) AS n, count(*) FILTER (c_custkey % 9 = 0) AS marks FROM customer)
{" UNION ALL ".join(f"SELECT '{level}' AS level, '{stage}' AS stage, {detail} AS detail FROM c, f, g" for level, stage, detail in _LOGGED)}""")
def clean_customer_log(spark, d):
    m = views.messy_customer(spark, d).withColumnRenamed("c_custkey", "_row_id")
    return cleaning.clean(m).tables["cleaning_log"]


@register("recommendations", f"""WITH v AS (SELECT {_BALANCE} AS balance, {_SEGMENT} AS segment FROM customer),
p AS (SELECT round(count(*) FILTER (balance IS NULL) * 100.0 / count(*), 1) AS a, round(count(*) FILTER (segment IS NULL) * 100.0 / count(*), 1) AS b FROM v)
SELECT CAST(1 AS INTEGER) AS kind, 'balance' AS variable, printf('''balance'' has %.1f%% missing — review before conclusions.', a) AS advice FROM p
UNION ALL SELECT 1, 'segment', printf('''segment'' has %.1f%% missing — review before conclusions.', b) FROM p
UNION ALL SELECT 2, 'raw_mixed', '''raw_mixed'' has mixed types (e.g., abc) — consider standardising.' FROM p""")
def recommendations(spark, d):
    none = literal_rows(spark, [], "variable string, outliers long")
    return cleaning.recommendations(column_summary(spark, d), mixed_columns(spark, d), none, 0, "iqr", "first")


_PLACE = {c: f"missing_{i:03d}" for i, c in enumerate(MESSY, 1)}


@register("cleaning_preview", f"""SELECT 'mixed' AS issue, 'raw_mixed' AS variable, 'abc' AS detail FROM (SELECT count(*) FROM customer)
UNION ALL SELECT '{_PLACE["raw_balance"]}', 'raw_balance', printf('%.1f%% missing', count(*) FILTER (c_custkey % 6 = 4) * 100.0 / count(*)) FROM customer
UNION ALL SELECT '{_PLACE["raw_segment"]}', 'raw_segment', printf('%.1f%% missing', count(*) FILTER (c_custkey % 9 = 0) * 100.0 / count(*)) FROM customer
UNION ALL SELECT '{_PLACE["raw_blank"]}', 'raw_blank', printf('%.1f%% missing', 100.0) FROM (SELECT count(*) FROM customer)
UNION ALL SELECT 'missing', '', format('{{:,}} missing values in 3 columns', count(*) FILTER (c_custkey % 6 = 4) + count(*) FILTER (c_custkey % 9 = 0) + count(*))
  FROM customer""")
def cleaning_preview(spark, d):
    m = cleaning.strip_and_null(views.messy_customer(spark, d), MESSY)
    rows = m.count()
    return cleaning.preview(_counts(spark, d), rows, dedup.duplicate_count(m, ["c_custkey"]), MESSY)


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "raw_date"]
_RAW_DATE = """CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%d/%m/%Y')
  WHEN o_orderkey % 5 = 2 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN o_orderkey % 5 = 3 THEN strftime(o_orderdate, '%b %-d %Y') ELSE '?' END"""


@register("dedup_first", f"SELECT o_orderkey AS _row_id, o_orderkey, o_custkey, o_orderstatus, o_totalprice, {_RAW_DATE} AS raw_date FROM orders")
def dedup_first(spark, d):
    return dedup.drop_duplicates(views.messy_orders(spark, d), _ORDER_COLS, "_row_id", "first")


@register("dedup_last", """SELECT CASE WHEN o_orderkey % 10 = 0 THEN o_orderkey + 1000000000 ELSE o_orderkey END AS _row_id, o_orderkey,
  o_custkey, o_orderstatus, o_totalprice FROM orders""")
def dedup_last(spark, d):
    return dedup.drop_duplicates(views.messy_orders(spark, d), _ORDER_COLS, "_row_id", "last").drop("raw_date")


@register("dup_flag", """SELECT _row_id, o_orderkey % 10 = 0 AS _duplicate_flag FROM (SELECT o_orderkey, o_orderkey AS _row_id FROM orders
  UNION ALL SELECT o_orderkey, o_orderkey + 1000000000 FROM orders WHERE o_orderkey % 10 = 0)""")
def dup_flag(spark, d):
    return dedup.flag_duplicates(views.messy_orders(spark, d), _ORDER_COLS, "_row_id").select("_row_id", "_duplicate_flag")


@register("dup_events", """SELECT count(*) AS n, count(*) FILTER (c > 1) AS flagged, count(DISTINCT (user_id, ts)) AS kept,
  count(*) - count(DISTINCT (user_id, ts)) AS duplicates FROM (SELECT *, count(*) OVER (PARTITION BY user_id, ts) AS c FROM
  (SELECT user_id % 40 AS user_id, CASE WHEN event_id % 3 = 0 THEN date_trunc('hour', ts) ELSE ts END AS ts FROM events))""")
def dup_events(spark, d):
    """Instants to the microsecond: dropping, flagging and counting agree."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 40).alias("user_id"), F.when(
        F.col("event_id") % 3 == 0, F.date_trunc("hour", "ts")).otherwise(F.col("ts")).alias("ts"))
    cols = ["user_id", "ts"]
    flags = dedup.flag_duplicates(e, cols, "event_id").agg(F.count("*").alias("n"), F.count_if("_duplicate_flag").alias("flagged"))
    kept = dedup.drop_duplicates(e, cols, "event_id").agg(F.count("*")).scalar()
    return flags.select("n", "flagged", kept.alias("kept"), dedup.duplicate_count(e, cols).select("duplicates").scalar().alias("duplicates"))


@register("dup_documents", """SELECT count(*) AS rows, count(DISTINCT text) AS distinct_rows, count(*) - count(DISTINCT text) AS duplicates
FROM documents""")
def dup_documents(spark, d):
    return dedup.duplicate_count(table(spark, d, "documents"), ["text"])


_FENCE = """q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events)"""


@register("outliers_iqr", f"""WITH {_FENCE} SELECT event_id, 'value' AS variable, value FROM events, q
WHERE value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)""")
def outliers_iqr(spark, d):
    return outliers.outlier_rows(table(spark, d, "events"), ["value"], "event_id")


@register("outliers_z", """WITH q AS (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events)
SELECT event_id, 'value' AS variable, value FROM events, q WHERE abs(value - m) / s > 3""")
def outliers_z(spark, d):
    return outliers.outlier_rows(table(spark, d, "events"), ["value"], "event_id", "zscore")


@register("outlier_counts", f"WITH {_FENCE} SELECT 'value' AS variable, count(*) AS outliers FROM events, q "
          "WHERE value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)")
def outlier_counts(spark, d):
    return outliers.outlier_counts(outliers.outlier_rows(table(spark, d, "events"), ["value", "user_id"], "event_id"))


def _impute_sql(fill: str) -> str:
    return f"""WITH v AS (SELECT c_custkey, {_BALANCE} AS balance, {_SEGMENT} AS segment FROM customer),
s AS (SELECT segment AS fs FROM v WHERE segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)
SELECT c_custkey, round(coalesce(balance, ({fill})), 4) AS balance, coalesce(segment, fs) AS segment FROM v, s"""


def _impute(strategy):
    def run(spark, d):
        return rounded(outliers.impute(_clean_customer(spark, d), ["balance"], ["segment"], strategy), "balance")
    return run


register("impute_median", _impute_sql("SELECT quantile_cont(balance, 0.5) FROM v"))(_impute("median"))
register("impute_mean", _impute_sql("SELECT avg(balance) FROM v"))(_impute("mean"))
register("impute_mode", _impute_sql("SELECT balance FROM v WHERE balance IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, balance LIMIT 1"))(_impute("mode"))
register("impute_leave", f"SELECT c_custkey, {_BALANCE} AS balance, {_SEGMENT} AS segment FROM customer")(_impute("leave"))


_GATED = ["customer", "lineitem", "orders", "part"]


@register("file_gate", " UNION ALL ".join(
    f"SELECT '{t}.parquet' AS file, count(*) AS rows, count(*) <= 10000 AS ok FROM {t}" for t in _GATED))
def file_gate(spark, d):
    out = None
    for t in _GATED:
        df = table(spark, d, t)
        part = readers.gate(readers.file_counts(df), len(df.columns), max_rows=10000)
        out = part if out is None else out.unionByName(part)
    return out.select(F.element_at(F.split("file", "/"), -1).alias("file"), "rows", "ok")


def _params():
    even = F.col("p_size") % 2 == 0
    return F.struct(F.when(even, F.col("p_brand")).alias("numeric_var"), F.when(even, F.col("p_type")).alias("group_var"),
                    F.when(~even, F.array("p_type", "p_brand", "p_type")).alias("columns"))


@register("extract_variables", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat(p_brand, '|', p_type) ELSE concat(p_type, '|', p_brand) END
  AS variables FROM part""")
def extract_variables(spark, d):
    names = sinks.extract_variables(F.to_json(_params()))
    return table(spark, d, "part").select("p_partkey", F.array_join(names, "|").alias("variables"))


@register("analysis_roundtrip", """SELECT p_partkey, 't_test' AS analysis_type, 'Untitled dataset' AS dataset_name,
  CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_type END AS first_variable, CAST(p_size AS BIGINT) AS n, 2 AS chart_count, '' AS interpretation FROM part""")
def analysis_roundtrip(spark, d):
    charts = F.array(F.struct(F.lit("Box").alias("title")), F.struct(F.lit("Means").alias("title")))
    count, titles = sinks.strip_charts(charts)
    results = F.struct(F.col("p_size").cast("long").alias("n"), count.alias("chart_count"), titles.alias("chart_titles"))
    saved = sinks.analysis_row(table(spark, d, "part"), F.lit("t_test"), F.lit(""), _params(), results, F.lit(None).cast("string"),
                               ["p_partkey"])
    back = sinks.read_analysis(saved, "n bigint, chart_count int, chart_titles array<string>")
    return back.select("p_partkey", "analysis_type", "dataset_name", F.get("variables", F.lit(0)).alias("first_variable"),
                       "results.n", "results.chart_count", "interpretation")


def _unlike(spark, d):
    """Saved results of three shapes and one that is no JSON, in one table that was written and read."""
    k = F.col("p_size") % 4
    body = (F.when(k == 0, F.to_json(F.struct(F.col("p_size").alias("n"), F.struct(F.col("p_type").alias("label")).alias("best"))))
            .when(k == 1, F.to_json(F.array(F.struct((F.col("p_size") / 4).alias("r")), F.struct(F.lit(0.5).alias("r")))))
            .when(k == 2, F.concat(F.lit('"'), F.col("p_brand"), F.lit('"'))).otherwise("{broken"))
    saved = table(spark, d, "part").select("p_partkey", F.concat(F.lit("kind"), k).alias("analysis_type"), body.alias("results"))
    folder = f"{checkpoint_folder(spark)}/variants-{uuid.uuid4().hex}"
    sinks.read_variants(saved).write.parquet(folder)
    return spark.read.parquet(folder)


@register("analysis_variants", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN CAST(p_size AS BIGINT) END AS n, CASE WHEN p_size % 4 = 0 THEN p_type END AS label,
  CASE WHEN p_size % 4 = 1 THEN p_size / 4.0 END AS r, CASE WHEN p_size % 4 = 2 THEN p_brand END AS word, p_size % 4 = 3 AS unreadable FROM part""")
def analysis_variants(spark, d):
    v = F.col("results")
    return _unlike(spark, d).select("p_partkey", F.try_variant_get(v, "$.n", "bigint").alias("n"), F.try_variant_get(v, "$.best.label", "string").alias("label"),
                                    F.try_variant_get(v, "$[0].r", "double").alias("r"), F.when(F.schema_of_variant(v) == "STRING", v.cast("string")).alias("word"), v.isNull().alias("unreadable"))


@register("analysis_shapes", """SELECT 'kind' || (p_size % 4) AS analysis_type, CASE p_size % 4 WHEN 0 THEN 'OBJECT<best: OBJECT<label: STRING>, n: BIGINT>' WHEN 2 THEN 'STRING' END AS shape, count(*) AS n
FROM part WHERE p_size % 4 <> 1 GROUP BY p_size % 4""")
def analysis_shapes(spark, d):
    return sinks.result_shapes(_unlike(spark, d)).where("analysis_type <> 'kind1'")


def _csv_files(spark, d):
    """Customers as two CSV files of different encoding and column order; the note holds a line break and an accent."""
    folder = f"{checkpoint_folder(spark)}/csv-{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select("c_custkey", F.concat(F.col("c_name"), F.lit("\n\u00e9t\u00e9, "), F.col("c_mktsegment")).alias("note"), "c_acctbal")
    c.where("c_custkey % 2 = 0").coalesce(1).write.option("header", True).csv(f"{folder}/a")
    c.where("c_custkey % 2 = 1").select("c_acctbal", "note", "c_custkey").coalesce(1).write.option("header", True).option(
        "encoding", "ISO-8859-1").csv(f"{folder}/b")
    return f"{folder}/*"


@register("csv_files", """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name || chr(10) || '\u00e9t\u00e9, ' || c_mktsegment AS note, round(c_acctbal, 2) AS c_acctbal FROM customer""")
def csv_files(spark, d):
    out = readers.read_csv(spark, _csv_files(spark, d))
    return out.select("c_custkey", "note", F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"))


@register("csv_row_ids", """SELECT count(*) AS rows, count(*) AS ids, 2 AS files, max(n) - 1 AS last FROM (SELECT count(*) OVER (PARTITION BY c_custkey % 2) AS n FROM customer)""")
def csv_row_ids(spark, d):
    out = readers.read_csv(spark, _csv_files(spark, d))
    return out.agg(F.count("*").alias("rows"), F.countDistinct(readers.ROW_ID).alias("ids"), F.countDistinct(readers.FILE).cast("int").alias("files"),
                   F.max(F.col(readers.ROW_ID).bitwiseAND(F.lit((1 << 40) - 1))).alias("last"))


@register("clean_folder", """SELECT count(*) AS rows, 3 AS columns FROM customer GROUP BY c_custkey % 2""")
def clean_folder(spark, d):
    out = clean_files(readers.read_csv(spark, _csv_files(spark, d)), f"{checkpoint_folder(spark)}/cleaned-{uuid.uuid4().hex}")
    return out.select("rows", F.col("columns").cast("int").alias("columns"))


def _ragged(spark, d):
    """Orders as CSV text in two folders whose files may share names: every third record has a cell beyond its header, every fifth a note of two lines."""
    k = F.col("o_orderkey")
    note = F.when(k % 5 == 0, F.concat(F.lit('"say ""'), F.col("o_orderpriority"), F.lit('"",\n'), F.col("o_orderstatus"), F.lit('"'))).otherwise(F.col("o_orderpriority"))
    line = F.concat_ws(",", k.cast("string"), note, F.format_string("%.2f", "o_totalprice"), F.when(k % 3 == 0, F.concat(F.lit("extra"), (k % 7).cast("string"))))
    rows = table(spark, d, "orders").select((k % 2).alias("half"), line.alias("value"))
    folder = f"{checkpoint_folder(spark)}/ragged-{uuid.uuid4().hex}"
    for half in (0, 1):
        head = spark.range(1).select(F.lit('key,"no\nte",price').alias("value"))
        part = head.unionByName(rows.where(F.col("half") == half).select("value"))
        # one file: its header is its first line
        part.coalesce(1).write.text(f"{folder}/{half}")
    return f"{folder}/*"


@register("csv_ragged", """SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'say "' || o_orderpriority || '",' || chr(10) || o_orderstatus ELSE o_orderpriority END AS note,
  printf('%.2f', o_totalprice) AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'extra' || (o_orderkey % 7) END AS more, o_orderkey % 2 AS file,
  row_number() OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) - 1 AS record FROM orders""")
def csv_ragged(spark, d):
    """No cell is lost: cells beyond the header, line breaks in quotes, a header of two lines; ids count the records of a file."""
    out = readers.read_csv(spark, _ragged(spark, d))
    ranked = out.withColumn("record", F.row_number().over(Window.partitionBy(readers.FILE, F.col("key").cast("long") % 2).orderBy(readers.ROW_ID)) - 1)
    return ranked.select("key", F.col("no\nte").alias("note"), "price", F.col("_c3").alias("more"), (F.col("key").cast("long") % 2).alias("file"),
                         F.col("record").cast("long").alias("record"))


def _customer_files(spark, d):
    """Two files of messy customers, both called part-...: one with all columns, one with other names for some of them."""
    m = views.messy_customer(spark, d)
    folder = f"{checkpoint_folder(spark)}/customers-{uuid.uuid4().hex}"
    even, odd = m.where("c_custkey % 2 = 0"), m.where("c_custkey % 2 = 1")
    even.write.option("header", True).option("escape", '"').csv(f"{folder}/even")
    odd.select("c_custkey", F.col("raw_balance").alias("price.usd"), F.col("raw_segment").alias("sex"), "raw_blank").write.option("header", True).option("escape", '"').csv(f"{folder}/odd")
    return folder


@register("clean_folder_cells", f"""WITH v AS (SELECT c_custkey, c_custkey % 2 = 0 AS even, {_BALANCE} AS b, {_SEGMENT} AS s, {_MODE} AS m FROM customer),
f AS (SELECT even, quantile_cont(b, 0.5) AS fb FROM v GROUP BY even),
g AS (SELECT even, s AS fs FROM v WHERE s IS NOT NULL GROUP BY even, s QUALIFY row_number() OVER (PARTITION BY even ORDER BY count(*) DESC, s) = 1)
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, CASE WHEN even THEN round(coalesce(b, fb), 4) END AS raw_balance, CASE WHEN NOT even THEN round(coalesce(b, fb), 4) END AS price,
  CASE WHEN even THEN coalesce(s, fs) END AS raw_segment, CASE WHEN NOT even THEN coalesce(s, fs) END AS gender, CASE WHEN even THEN m END AS raw_mode
FROM v JOIN f USING (even) JOIN g USING (even)""")
def clean_folder_cells(spark, d):
    """The cleaned cells of a folder: every file with its own types, fills and names, in one partitioned table."""
    folder = _customer_files(spark, d)
    merged = readers.read_csv(spark, [f"{folder}/even", f"{folder}/odd"], header=HEADER)
    # the files of a folder count as one source
    merged = merged.withColumn(readers.FILE, F.regexp_extract(readers.FILE, "/(even|odd)/", 1))
    clean_files(merged, f"{folder}/out")
    out = spark.read.parquet(f"{folder}/out/cleaned_data")
    return rounded(out.select(F.col("c_custkey").cast("bigint").cast("string").alias("c_custkey"), "raw_balance", F.col("priceusd").alias("price"), "raw_segment", F.col("Gender").alias("gender"),
                              "raw_mode"), "raw_balance", "price")
