"""Registered queries: ledger, prices, rosters, share links, roll-ups."""

from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.catalog import views
from statloom.catalog.views import table
from statloom.operators import accounts, dedup, ledger
from statloom.operators.asof import last_known

QUERIES: dict = {}
NOW = "2024-01-20 00:00:00"


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def values(rows: list[tuple], columns: str) -> str:
    def lit(v):
        if isinstance(v, float):
            return f"CAST({v} AS DOUBLE)"
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS {columns}"


_LEDGER = """l AS (SELECT event_id, ts, user_id, event_type AS reason, value,
  CAST(CASE WHEN event_type IN ('purchase', 'signup') THEN ceil(value) WHEN event_type IN ('click', 'view') THEN -ceil(value) END AS BIGINT)
  AS delta FROM events WHERE event_type <> 'error' AND ceil(value) > 0)"""


# --- ledger ------------------------------------------------------------------------

@register("ledger_entries", f"WITH {_LEDGER} SELECT user_id, event_id, reason, delta FROM l")
def ledger_entries(spark, d):
    e = table(spark, d, "events").withColumn("amount", F.ceil("value"))
    return ledger.entry_rows(e, "user_id", "event_type", "amount", ["purchase", "signup"], ["click", "view"], ["event_id"])


@register("running_balance", f"""WITH {_LEDGER} SELECT event_id, user_id, delta, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM l""")
def running_balance(spark, d):
    return ledger.running_balance(views.ledger(spark, d)).select("event_id", "user_id", "delta", "balance")


def _gappy(spark, d):
    """The ledger with a null time on every seventh row and a null account on every fifth user's rows."""
    rows = views.ledger(spark, d)
    return rows.withColumns({"ts": F.when(F.col("event_id") % 7 != 0, F.col("ts")), "user_id": F.when(F.col("user_id") % 5 != 0, F.col("user_id"))})


_GAPPY = f"""{_LEDGER}, g AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts, CASE WHEN user_id % 5 <> 0 THEN user_id END AS user_id, delta FROM l)"""


@register("running_balance_nulls", f"""WITH {_GAPPY} SELECT event_id, user_id, delta, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM g""")
def running_balance_nulls(spark, d):
    """Rows without a time come first, rows without an account are one account; no row is lost."""
    return ledger.running_balance(_gappy(spark, d)).select("event_id", "user_id", "delta", "balance")


@register("daily_quota_nulls", f"""WITH {_GAPPY}, r AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
  ORDER BY ts NULLS FIRST, event_id) AS used FROM g) SELECT event_id, user_id, day, used, used <= 2 AS allowed FROM r""")
def daily_quota_nulls(spark, d):
    return ledger.daily_quota(_gappy(spark, d), "user_id", "ts", ["event_id"], 2).select("event_id", "user_id", "day", "used", "allowed")


@register("latest_balance", f"WITH {_LEDGER} SELECT user_id, CAST(sum(delta) AS BIGINT) AS balance FROM l GROUP BY 1")
def latest_balance(spark, d):
    return ledger.latest_balance(ledger.running_balance(views.ledger(spark, d)))


@register("top_n_history", f"""WITH {_LEDGER} SELECT user_id, event_id, reason, delta, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM l) WHERE rn <= 50""")
def top_n_history(spark, d):
    out = ledger.history(views.ledger(spark, d), "user_id", ["ts", "event_id"])
    return out.select("user_id", "event_id", "reason", "delta", "rn")


@register("balance_audit", f"""WITH {_LEDGER}, b AS (SELECT *, CAST(sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id
  ROWS UNBOUNDED PRECEDING) AS BIGINT) AS expected FROM l)
SELECT event_id, user_id, expected + 1 AS stored, expected FROM b WHERE event_id % 50 = 0""")
def balance_audit(spark, d):
    """Stored balances with every fiftieth row off by one; the audit must find exactly those."""
    good = ledger.running_balance(views.ledger(spark, d))
    stored = good.withColumn("stored", F.col("balance") + F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)).drop("balance")
    return ledger.audit_balances(stored, "stored", "user_id", "ts", ["event_id"], "delta").select(
        "event_id", "user_id", "stored", "expected")


_REPLAY = f"""WITH RECURSIVE {_LEDGER}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM l),
r AS (SELECT user_id, event_id, rn, delta, CASE WHEN delta >= 0 THEN delta ELSE 0 END AS balance, delta >= 0 AS accepted,
    CASE WHEN delta >= 0 THEN 0 ELSE -delta END AS shortfall FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.event_id, o.rn, o.delta, CASE WHEN o.delta >= 0 OR r.balance + o.delta >= 0 THEN r.balance + o.delta ELSE r.balance END,
    o.delta >= 0 OR r.balance + o.delta >= 0, CASE WHEN o.delta >= 0 OR r.balance + o.delta >= 0 THEN 0 ELSE -o.delta - r.balance END
  FROM r JOIN o ON o.user_id = r.user_id AND o.rn = r.rn + 1)"""


@register("spend_replay", f"{_REPLAY} SELECT user_id, event_id, delta, CAST(balance AS BIGINT) AS balance, accepted, "
          "CAST(shortfall AS BIGINT) AS shortfall FROM r")
def spend_replay(spark, d):
    return ledger.replay_by_need(views.ledger(spark, d)).select("user_id", "event_id", "delta", "balance", "accepted", "shortfall")


@register("spend_replay_totals", f"{_REPLAY} SELECT user_id, CAST(sum(CASE WHEN accepted THEN delta ELSE 0 END) AS BIGINT) AS balance, "
          "count(*) FILTER (NOT accepted) AS rejected FROM r GROUP BY 1")
def spend_replay_totals(spark, d):
    out = ledger.replay_spends(views.ledger(spark, d))
    return out.groupBy("user_id").agg(F.sum(F.when(F.col("accepted"), F.col("delta")).otherwise(0)).alias("balance"),
                                      F.count_if(~F.col("accepted")).alias("rejected"))


# --- prices ------------------------------------------------------------------------

_PRICES = values([(i, k, label, c) for i, (k, label, c) in enumerate(fv.PRICES)], "p(position, key, label, credits)")
_PICK = "(event_id % 22)"


def _requests(spark, d):
    """Events as analysis requests: the test by event id (two ids have no price), role and user by user id."""
    names = F.array(*[F.lit(k) for k, _, _ in fv.PRICES], F.lit("unknown"), F.lit("regression"))
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", F.element_at(names, (F.col("event_id") % 22 + 1).cast("int")).alias("analysis"),
                    (F.col("event_id") % 3).alias("predictors"),
                    F.when(F.col("user_id") % 10 == 0, "professional_subscriber").otherwise("free").alias("role"),
                    F.when(F.col("user_id") % 7 != 0, F.col("user_id")).alias("payer"))


@register("price_charge", f"""WITH r AS (SELECT event_id, user_id, CASE WHEN {_PICK} = 20 THEN 'unknown' WHEN {_PICK} = 21 THEN 'regression'
  ELSE (SELECT key FROM {_PRICES} WHERE position = {_PICK}) END AS analysis, event_id % 3 AS predictors FROM events),
c AS (SELECT r.*, coalesce(p.credits, 0) AS credits FROM r LEFT JOIN {_PRICES}
  ON p.key = CASE WHEN analysis = 'regression' AND predictors > 1 THEN 'multiple_regression' ELSE analysis END)
SELECT event_id, analysis, CAST(CASE WHEN user_id % 10 = 0 THEN 0 ELSE credits END AS INTEGER) AS cost,
  CASE WHEN credits = 0 THEN 'free' WHEN user_id % 10 = 0 THEN 'covered' WHEN user_id % 7 = 0 THEN 'signin_required' ELSE 'charge' END
  AS decision FROM c""")
def price_charge(spark, d):
    out = ledger.charge(_requests(spark, d), "analysis", F.col("predictors"), F.col("role"), F.col("payer"))
    return out.select("event_id", "analysis", "cost", "decision")


@register("price_list_demand", f"""WITH n AS (SELECT CASE WHEN {_PICK} = 21 THEN (SELECT position FROM {_PRICES} WHERE key = 'regression') ELSE {_PICK} END AS position,
  count(*) AS requests FROM events GROUP BY 1)
SELECT CAST(position AS INTEGER) AS position, key, label, CAST(credits AS INTEGER) AS credits, credits = 0 AS free, coalesce(requests, 0) AS requests
FROM {_PRICES} LEFT JOIN n USING (position)""")
def price_list_demand(spark, d):
    asked = _requests(spark, d).groupBy(F.col("analysis").alias("key")).agg(
        F.count("*").alias("requests"))
    return ledger.price_table(spark).join(asked, "key", "left").select(
        "position", "key", "label", "credits", "free", F.coalesce("requests", F.lit(0)).alias("requests"))


_CUR = "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, (c, _) in enumerate(fv.RATES)) + " ELSE 'JPY' END"


def _amounts(spark, d):
    names = F.array(*[F.lit(c) for c, _ in fv.RATES], F.lit("jpy"))
    return table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("double").alias("usd"), F.element_at(
        names, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("currency"))


@register("fx_convert", f"""SELECT o_orderkey, rate, round(CASE WHEN cur = 'NGN' THEN round(usd * rate, 0) ELSE round(usd * rate, 2) END, 2) AS converted
FROM (SELECT o_orderkey, floor(o_totalprice) AS usd, cur, coalesce(rate, 1.0) AS rate FROM (SELECT *, {_CUR} AS cur FROM orders)
  LEFT JOIN {values(fv.RATES, 't(c, rate)')} ON c = cur)""")
def fx_convert(spark, d):
    return ledger.convert(_amounts(spark, d), "usd", "currency").select("o_orderkey", "rate", "converted")


_SYM = values(fv.CURRENCY_PREFIX, "s(sc, symbol)")


@register("price_texts", f"""SELECT o_orderkey, CASE WHEN cur = 'USD' THEN concat('$', CAST(CAST(usd AS BIGINT) AS VARCHAR))
  WHEN cur = 'NGN' THEN concat(symbol, format('{{:,}}', CAST(round(usd * rate, 0) AS BIGINT)), ' (~$', CAST(CAST(usd AS BIGINT) AS VARCHAR), ')')
  ELSE concat(coalesce(symbol, concat(cur, ' ')), format('{{:,.2f}}', round(usd * coalesce(rate, 1.0), 2)), ' (~$', CAST(CAST(usd AS BIGINT) AS VARCHAR), ')')
  END AS price FROM (SELECT o_orderkey, floor(o_totalprice) AS usd, {_CUR} AS cur FROM orders)
  LEFT JOIN {values(fv.RATES, 't(c, rate)')} ON c = cur LEFT JOIN {_SYM} ON sc = cur""")
def price_texts(spark, d):
    return ledger.priced_text(_amounts(spark, d), "usd", "currency").select("o_orderkey", "price")


_CC = ["NG", "GH", "KE", "ZA", "GB", "US", "FR"]


@register("country_settings", f"""SELECT c_custkey, coalesce(currency, 'USD') AS currency, coalesce(gateway, 'lemonsqueezy') AS gateway
FROM (SELECT c_custkey, CASE c_custkey % 8 {' '.join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CC))} END AS cc FROM customer)
LEFT JOIN {values(fv.COUNTRIES, 't(code, currency, gateway)')} ON code = cc""")
def country_settings(spark, d):
    codes = F.array(*[F.lit(c.lower()) for c in _CC], F.lit(None).cast("string"))
    c = table(spark, d, "customer").select("c_custkey", F.element_at(codes, (F.col("c_custkey") % 8 + 1).cast("int")).alias("cc"))
    return ledger.country_settings(c, "cc").select("c_custkey", "currency", "gateway")


@register("pack_sales", f"""SELECT pack, count(*) AS sales, CAST(sum(credits) AS BIGINT) AS credits, CAST(sum(usd) AS BIGINT) AS usd,
  CAST(sum(credits - usd) AS BIGINT) AS saving FROM (SELECT CASE event_id % 5 WHEN 0 THEN 'pack_5' WHEN 1 THEN 'pack_15' WHEN 2 THEN 'pack_40'
  WHEN 3 THEN 'pack_100' ELSE 'pack_7' END AS pack FROM events WHERE event_type = 'purchase')
LEFT JOIN {values(fv.PACKS, 't(id, credits, usd, label)')} ON id = pack GROUP BY 1""")
def pack_sales(spark, d):
    names = F.array(*[F.lit(p[0]) for p in fv.PACKS], F.lit("pack_7"))
    e = table(spark, d, "events").where("event_type = 'purchase'")
    bought = e.select(F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("pack"))
    return ledger.packs(bought, "pack").groupBy("pack").agg(
        F.count("*").alias("sales"), *[F.sum(c).alias(c) for c in ("credits", "usd", "saving")])


# --- quotas and allowances ------------------------------------------------------------

@register("daily_quota", """WITH r AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE)
  ORDER BY ts, event_id) AS used FROM events)
SELECT event_id, user_id, day, used, used <= 2 AS allowed, greatest(2 - used, 0) AS remaining FROM r""")
def daily_quota(spark, d):
    out = ledger.daily_quota(table(spark, d, "events"), "user_id", "ts", ["event_id"], 2)
    return out.select("event_id", "user_id", "day", "used", "allowed", "remaining")


_PLAN = "CASE user_id % 3 WHEN 0 THEN 'student' WHEN 1 THEN 'researcher' ELSE 'professional' END"


@register("monthly_usage", f"""WITH u AS (SELECT user_id, date_trunc('month', ts) AS month, count(*) AS used, {_PLAN} AS plan FROM events GROUP BY ALL)
SELECT u.user_id, strftime(month, '%Y-%m') AS month, used, u.plan, n = -1 OR used <= n AS within_plan
FROM u JOIN {values([(k, n) for k, _, n in fv.PLANS], 't(plan, n)')} ON t.plan = u.plan""")
def monthly_usage(spark, d):
    plan = F.element_at(F.array(*[F.lit(p[0]) for p in fv.PLANS]), (F.col("user_id") % 3 + 1).cast("int"))
    out = ledger.monthly_usage(table(spark, d, "events"), "user_id", "ts", plan)
    return out.select("user_id", F.date_format("month", "yyyy-MM").alias("month"), "used", "plan", "within_plan")


_CLASS = """c AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS class_name, CAST(n_nationkey % 5 + 1 AS BIGINT) AS allowance,
  n_nationkey % 6 <> 0 AS is_active FROM nation),
s AS (SELECT c_custkey AS student_id, CAST(c_nationkey AS BIGINT) AS class_id, c_custkey % 7 <> 0 AS is_active FROM customer)"""


def _granted(spark, d):
    """Enrolments with the time of the student's last order as last grant."""
    last = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("student_id")).agg(
        F.max("o_orderdate").alias("last_allowance_at"))
    return views.enrolments(spark, d).join(last, "student_id", "left")


_ORDER_NOW = "(SELECT max(o_orderdate) FROM orders)"


@register("allowance_due", f"""WITH {_CLASS}, g AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT s.student_id, s.class_id, c.allowance AS granted FROM s JOIN c ON c.id = s.class_id LEFT JOIN g ON o_custkey = s.student_id
WHERE s.is_active AND c.is_active AND (last IS NULL OR floor((epoch({_ORDER_NOW}) - epoch(last)) / 86400) >= 30)""")
def allowance_due(spark, d):
    moment = table(spark, d, "orders").agg(F.max(F.col("o_orderdate").cast("timestamp"))).scalar()
    return ledger.due_allowances(_granted(spark, d), views.classes(spark, d), moment).select("student_id", "class_id", "granted")


_DAYS = [f"{year}-{month}-01" for year in range(1992, 2000) for month in ("03", "09")]


@register("allowance_due_days", f"""WITH {_CLASS}, t AS (SELECT unnest({[f"{d}" for d in _DAYS]})::TIMESTAMP AS day),
a AS (SELECT s.student_id, s.class_id, c.allowance, t.day, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = s.student_id AND o_orderdate <= t.day) AS last
  FROM s JOIN c ON c.id = s.class_id, t WHERE s.is_active AND c.is_active)
SELECT strftime(day, '%Y-%m-%d') AS day, student_id, class_id, allowance AS granted FROM a WHERE last IS NULL OR floor((epoch(day) - epoch(last)) / 86400) >= 30""")
def allowance_due_days(spark, d):
    """Allowances due on many days at once, from the history of grants."""
    grants = table(spark, d, "orders").select(F.col("o_custkey").alias("student_id"), F.col("o_orderdate").alias("last_allowance_at"))
    out = ledger.due_on_days(views.enrolments(spark, d), views.classes(spark, d), grants, _DAYS)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "student_id", "class_id", "granted")


@register("balance_as_of", f"""WITH {_LEDGER}, b AS (SELECT user_id, ts, event_id, sum(delta) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS balance FROM l)
SELECT e.event_id, CAST(b.balance AS BIGINT) AS balance FROM events e ASOF LEFT JOIN (SELECT user_id, ts, arg_max(balance, event_id) AS balance FROM b GROUP BY 1, 2) b
  ON e.user_id = b.user_id AND e.ts >= b.ts WHERE e.event_type = 'error'""")
def balance_as_of(spark, d):
    """The balance that stood when an error happened."""
    errors = table(spark, d, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    stood = ledger.running_balance(views.ledger(spark, d)).select("user_id", "ts", F.col("event_id").alias("of"), "balance")
    return last_known(errors, stood, ["user_id"], "ts", ["balance"], ["of"]).select("event_id", "balance")


@register("audit_details", """SELECT event_type AS action, json_extract_string(props, '$.k')::BIGINT % 10 AS last_digit, count(*) AS n FROM events GROUP BY 1, 2""")
def audit_details(spark, d):
    """Details of any shape, read by path."""
    details = accounts.audit_details(table(spark, d, "events"), "event_type", "props", {"k": "bigint"})
    return details.groupBy("action", (F.col("k") % 10).alias("last_digit")).agg(F.count("*").alias("n"))


@register("audit_detail_fields", """SELECT event_type AS action, 'k' AS field, 'BIGINT' AS type, count(*) AS n FROM events WHERE json_extract(props, '$.k') IS NOT NULL GROUP BY 1""")
def audit_detail_fields(spark, d):
    """What the details hold, without knowing it before."""
    return accounts.detail_fields(table(spark, d, "events"), "event_type", "props")


@register("allowance_totals", f"""WITH {_CLASS}, g AS (SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY 1)
SELECT s.class_id, count(*) AS students, CAST(sum(c.allowance) AS BIGINT) AS granted FROM s JOIN c ON c.id = s.class_id
LEFT JOIN g ON o_custkey = s.student_id WHERE s.is_active AND c.is_active
AND (last IS NULL OR floor((epoch({_ORDER_NOW}) - epoch(last)) / 86400) >= 30) GROUP BY 1""")
def allowance_totals(spark, d):
    return allowance_due(spark, d).groupBy("class_id").agg(F.count("*").alias("students"), F.sum("granted").alias("granted"))


@register("subscription_state", """WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'active' WHEN 'error' THEN 'cancelled' END AS status,
  CASE WHEN event_type = 'purchase' THEN 'researcher' WHEN event_type = 'signup' THEN 'student' END AS plan FROM events)
SELECT user_id, arg_max(status, (ts, event_id)) FILTER (status IS NOT NULL) AS status,
  arg_max(plan, (ts, event_id)) FILTER (plan IS NOT NULL) AS plan FROM e GROUP BY 1""")
def subscription_state(spark, d):
    kind = F.col("event_type")
    changes = table(spark, d, "events").select(
        "user_id", "event_id", "ts", F.when(kind == "signup", "active").when(kind == "error", "cancelled").alias("status"),
        F.when(kind == "purchase", "researcher").when(kind == "signup", "student").alias("plan"))
    return ledger.current_state(changes, "user_id", ["ts", "event_id"], ["status", "plan"])


# --- rosters and dashboards ----------------------------------------------------------------

_ACTIONS = ["view", "purchase"]
_ACTIVITY = "a AS (SELECT user_id, count(*) AS n FROM events WHERE event_type IN ('view', 'purchase') GROUP BY 1)"


@register("activity_counts", f"WITH {_ACTIVITY} SELECT user_id, n AS analyses_run FROM a")
def activity_counts(spark, d):
    return accounts.activity_counts(views.audit(spark, d), "user_id", "action", _ACTIONS)


def _roster(spark, d):
    return accounts.roster(views.enrolments(spark, d), views.users(spark, d), activity_counts(spark, d))


@register("class_roster", f"""WITH {_CLASS}, {_ACTIVITY} SELECT class_id, student_id, concat(lower(c_name), '@mail.test') AS email, s.is_active,
  coalesce(n, 0) AS analyses_run FROM s JOIN customer ON c_custkey = student_id LEFT JOIN a ON user_id = student_id""")
def class_roster(spark, d):
    return _roster(spark, d).select("class_id", "student_id", "email", "is_active", "analyses_run")


@register("activity_dashboard", f"""WITH {_CLASS}, {_ACTIVITY} SELECT c.id, c.class_name, count(student_id) AS total_students,
  count(*) FILTER (s.is_active) AS active_students, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_analyses
FROM c LEFT JOIN s ON s.class_id = c.id LEFT JOIN a ON user_id = student_id GROUP BY 1, 2""")
def activity_dashboard(spark, d):
    return accounts.class_dashboard(views.classes(spark, d), _roster(spark, d))


@register("class_codes", """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS id FROM customer""")
def class_codes(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    asked = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.when(F.col("c_custkey") % 11 == 0, F.lit("nowhere!")).otherwise(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")))
    return accounts.resolve_codes(asked.select("c_custkey", code.alias("code")), views.classes(spark, d), "code").select("c_custkey", "id")


@register("enrol_new", """SELECT DISTINCT CAST(c_nationkey AS BIGINT) AS class_id, o_custkey AS student_id FROM orders JOIN customer ON c_custkey = o_custkey
WHERE c_custkey % 7 = 0""")
def enrol_new(spark, d):
    """Every order is a request of its customer to join their class; only students who left may join again."""
    asked = table(spark, d, "orders").select(F.col("o_custkey").alias("student_id")).join(
        views.enrolments(spark, d).select("student_id", "class_id"), "student_id")
    return dedup.new_enrolments(asked, views.enrolments(spark, d).where("is_active"), ["class_id", "student_id"])


@register("active_enrolments", """SELECT c_custkey AS student_id, CAST(c_nationkey AS BIGINT) AS class_id, CAST(n_regionkey AS BIGINT) AS lecturer_id
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 <> 0 AND n_regionkey = 2""")
def active_enrolments(spark, d):
    own = views.classes(spark, d).where("lecturer_id = 2").select(F.col("id").alias("class_id"), "lecturer_id")
    return views.enrolments(spark, d).where("is_active").join(own, "class_id").select("student_id", "class_id", "lecturer_id")


@register("class_requests", """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS class_name, CASE WHEN c_custkey % 10 = 0 THEN
  'Class name is required.' WHEN c_acctbal < 0 THEN 'Monthly allowance cannot be negative.' END AS reason FROM customer""")
def class_requests(spark, d):
    name = F.when(F.col("c_custkey") % 10 == 0, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("c_mktsegment")))
    asked = table(spark, d, "customer").select("c_custkey", name.alias("class_name"), F.col("c_acctbal").alias("monthly_allowance"))
    return accounts.valid_requests(asked).select("c_custkey", "class_name", "reason")


def _members(spark, d):
    """Customers as user rows, joined at the date of their first order."""
    first = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created_at"))
    c = views.enrolments(spark, d).select(F.col("student_id").alias("id"), "is_active")
    plan = F.when(F.col("id") % 3 == 0, "student").otherwise("researcher").alias("plan")
    return views.users(spark, d).join(c, "id").join(first, "id").select("id", "email", "is_active", "created_at", plan)


_MEMBERS = """m AS (SELECT c_custkey AS id, concat(lower(c_name), '@mail.test') AS email, c_custkey % 7 <> 0 AS is_active, min(o_orderdate) AS created_at,
  CASE WHEN c_custkey % 3 = 0 THEN 'student' ELSE 'researcher' END AS plan FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)"""


@register("user_filter", f"WITH {_MEMBERS} SELECT id, email FROM m WHERE contains(email, '12') AND is_active AND plan = 'student' "
          "AND created_at >= TIMESTAMP '1992-03-01' AND created_at <= TIMESTAMP '1999-12-31'")
def user_filter(spark, d):
    return accounts.filter_users(_members(spark, d), "12", "active", "student", "1992-03-01", "1999-12-31").select("id", "email")


@register("user_page", f"""WITH {_MEMBERS}, p AS (SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn FROM m)
SELECT id, email FROM p WHERE rn BETWEEN 26 AND 50""")
def user_page(spark, d):
    members = _members(spark, d)
    last = accounts.user_page(members, ["created_at", "id"]).agg(F.min(F.struct("created_at", "id")).alias("m")).first()["m"]
    return accounts.user_page(members, ["created_at", "id"], (last["created_at"], last["id"])).select("id", "email")


@register("admin_kpis", f"""WITH {_LEDGER} SELECT (SELECT count(*) FROM customer) AS total_users,
  (SELECT count(DISTINCT user_id) FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15') AS active_today,
  CAST(sum(CASE WHEN delta > 0 THEN delta ELSE 0 END) AS BIGINT) AS credits_sold,
  CAST(-sum(CASE WHEN delta < 0 THEN delta ELSE 0 END) AS BIGINT) AS credits_consumed,
  round(sum(CASE WHEN reason = 'purchase' THEN round(value, 2) END), 2) AS revenue_usd,
  (SELECT count(*) FROM (SELECT arg_max(event_type, (ts, event_id)) AS s FROM events WHERE event_type IN ('signup', 'error') GROUP BY user_id)
   WHERE s = 'signup') AS active_subscriptions FROM l""")
def admin_kpis(spark, d):
    return accounts.admin_kpis(views.users(spark, d), views.audit(spark, d), views.ledger(spark, d),
                               F.lit("2024-01-15").cast("date"), subscription_state(spark, d))


@register("user_detail", f"""WITH {_LEDGER}, {_ACTIVITY}, b AS (SELECT user_id, CAST(sum(delta) AS BIGINT) AS balance FROM l GROUP BY 1),
e AS (SELECT user_id, min(ts) AS created_at, arg_max(event_type, (ts, event_id)) AS last_action, max(ts) AS last_at FROM events GROUP BY 1),
s AS (SELECT user_id, arg_max(CASE event_type WHEN 'signup' THEN 'active' WHEN 'error' THEN 'cancelled' END, (ts, event_id))
    FILTER (event_type IN ('signup', 'error')) AS st,
  arg_max(CASE event_type WHEN 'purchase' THEN 'researcher' ELSE 'student' END, (ts, event_id)) FILTER (event_type IN ('purchase', 'signup')) AS pl
  FROM events GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM l),
t AS (SELECT user_id, string_agg(reason || ' ' || delta, ', ' ORDER BY rn) AS transactions FROM r WHERE rn <= 15 GROUP BY 1)
SELECT e.user_id, coalesce(balance, 0) AS balance, strftime(created_at, '%Y-%m-%d') AS joined,
  CASE WHEN e.user_id % 9 = 0 THEN 'Suspended' ELSE 'Active' END AS status, CASE WHEN st IS NULL OR pl IS NULL THEN 'None' ELSE pl || ' (' || st || ')' END
  AS subscription, last_action, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_activity_at, coalesce(n, 0) AS tests_saved, transactions
FROM e LEFT JOIN b USING (user_id) LEFT JOIN a USING (user_id) LEFT JOIN s USING (user_id) LEFT JOIN t USING (user_id)""")
def user_detail(spark, d):
    book = views.ledger(spark, d)
    profiles = views.audit(spark, d).groupBy("user_id").agg(F.min("ts").alias("created_at")).withColumn("is_active", F.col("user_id") % 9 != 0)
    balances = ledger.latest_balance(ledger.running_balance(book))
    newest = ledger.history(book, "user_id", ["ts", "event_id"], 15)
    out = accounts.user_detail(profiles, views.audit(spark, d), balances, activity_counts(spark, d), subscription_state(spark, d), newest)
    moves = F.transform("transactions", lambda t: F.concat_ws(" ", t["reason"], t["delta"].cast("string")))
    return out.withColumns({"last_activity_at": F.date_format("last_activity_at", "yyyy-MM-dd HH:mm:ss"), "joined": F.col("joined").cast("string"),
                            "transactions": F.array_join(moves, ", ")})


@register("payments", f"""WITH {_LEDGER} SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'paystack' ELSE 'lemonsqueezy' END AS gateway,
  'Credit Pack' AS kind, round(value, 2) AS amount_usd FROM l WHERE reason = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 50""")
def payments(spark, d):
    return accounts.payments(views.ledger(spark, d), ["ts", "event_id"]).select("event_id", "gateway", "kind", "amount_usd")


@register("referral_funnel", """WITH f AS (SELECT c_nationkey, min(c_custkey) AS referrer FROM customer GROUP BY 1),
r AS (SELECT referrer, c_custkey IN (SELECT o_custkey FROM orders) AS q FROM customer JOIN f USING (c_nationkey) WHERE c_custkey <> referrer),
s AS (SELECT referrer, count(*) AS total, count(*) FILTER (q) AS n FROM r GROUP BY 1)
SELECT referrer, total AS total_referred, n AS qualified_count, CAST(CASE WHEN n >= 10 THEN 2 WHEN n >= 3 THEN 1 ELSE 0 END AS INTEGER) AS milestones_reached,
  CASE WHEN n < 3 THEN '5 free credits' WHEN n < 10 THEN '1 free Thesis Package' END AS next_reward,
  CAST(CASE WHEN n < 3 THEN 3 - n WHEN n < 10 THEN 10 - n END AS BIGINT) AS remaining FROM s""")
def referral_funnel(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    first = c.groupBy("c_nationkey").agg(F.min("c_custkey").alias("referrer"))
    buyers = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("qualified", F.lit(True))
    rows = c.join(first, "c_nationkey").where(F.col("c_custkey") != F.col("referrer")).join(buyers, "c_custkey", "left")
    return accounts.referral_funnel(rows.withColumn("qualified", F.coalesce("qualified", F.lit(False))))


@register("audit_rollup", "SELECT event_type AS action, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def audit_rollup(spark, d):
    return accounts.audit_rollup(views.audit(spark, d), "action", "ts")


@register("audit_agents", "SELECT doc_id, left(text, 300) AS agent FROM documents")
def audit_agents(spark, d):
    return accounts.audit_rows(table(spark, d, "documents").select("doc_id", F.col("text").alias("agent")), "agent")


# --- share links ------------------------------------------------------------------------

def _links(spark, d):
    """Purchases as share links; the ids past the last part point to analyses that are gone."""
    e = table(spark, d, "events").where("event_type = 'purchase'")
    out = accounts.share_links(e, "event_id", F.col("ts"))
    return out.select(F.col("analysis_id").alias("token"), F.floor(F.col("analysis_id") / 4).alias("analysis_id"), "created_at", "expires_at")


def _analyses(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("analysis_id"), F.col("p_name").alias("title"))


_NOW30 = "TIMESTAMP '2024-02-15 00:00:00'"
_LINKS = """k AS (SELECT event_id AS token, CAST(floor(event_id / 4.0) AS BIGINT) AS analysis_id, ts + INTERVAL 30 DAYS AS expires_at FROM events WHERE event_type = 'purchase'),
n AS (SELECT p_partkey AS analysis_id, p_name AS title FROM part)"""


@register("shared_analyses", f"""WITH {_LINKS} SELECT e.event_id AS token, CASE WHEN k.token IS NULL THEN 404 WHEN expires_at < {_NOW30} THEN 410
  WHEN title IS NULL THEN 404 ELSE 200 END AS code, title FROM events e LEFT JOIN k ON k.token = e.event_id LEFT JOIN n USING (analysis_id)""")
def shared_analyses(spark, d):
    """Every event id is tried as a token; only purchases made links."""
    asked = table(spark, d, "events").select(F.col("event_id").alias("token"))
    moment = F.lit("2024-02-15 00:00:00").cast("timestamp_ntz")
    return accounts.resolve_share(asked, _links(spark, d), _analyses(spark, d), moment).select("token", "code", "title")


@register("shared_charts", f"""WITH {_LINKS} SELECT token, 'chart-' || CAST(p_partkey AS VARCHAR) AS chart_url FROM k JOIN n USING (analysis_id)
LEFT JOIN part ON CAST(floor(p_partkey / 2.0) AS BIGINT) = analysis_id""")
def shared_charts(spark, d):
    shared = _links(spark, d).join(_analyses(spark, d), "analysis_id")
    charts = table(spark, d, "part").select(F.floor(F.col("p_partkey") / 2).alias("analysis_id"),
                                            F.concat(F.lit("chart-"), F.col("p_partkey").cast("string")).alias("chart_url"))
    return accounts.shared_contents(shared, charts).select("token", "chart_url")


@register("orphan_links", f"WITH {_LINKS} SELECT token, analysis_id FROM k WHERE analysis_id NOT IN (SELECT analysis_id FROM n)")
def orphan_links(spark, d):
    return accounts.orphan_links(_links(spark, d), _analyses(spark, d)).select("token", "analysis_id")


@register("expired_links", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN false ELSE ts < TIMESTAMP '2024-01-20 00:00:00' END AS expired FROM events""")
def expired_links(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, "not a date").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return table(spark, d, "events").select("event_id", accounts.is_expired(text, F.lit(NOW).cast("timestamp")).alias("expired"))


@register("link_views", """WITH k AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
SELECT k.user_id, count(e.event_id) AS view_count FROM k LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') e USING (user_id) GROUP BY 1""")
def link_views(spark, d):
    e = table(spark, d, "events")
    links = e.where("event_type = 'purchase'").select("user_id").distinct()
    return accounts.view_counts(links, e.where("event_type = 'view'"), "user_id").select("user_id", "view_count")
