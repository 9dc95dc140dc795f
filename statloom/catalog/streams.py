"""Registered queries: streaming jobs drained over the event table."""

import uuid

from pyspark.sql import functions as F

from statloom.catalog.accounts import _REPLAY
from statloom.session import checkpoint_folder
from statloom.streaming import jobs, profiles, timed

QUERIES: dict = {}


def register(name, sql=None):
    def keep(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return keep


def closed(spark, d, job):
    """A windowed job drained to its last window."""
    markers = jobs.marker_folder(spark)
    return jobs.drain(job(jobs.event_stream(spark, d, markers=markers)), markers=markers)


def wall(c):
    """An instant as wall-clock text."""
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSS")


@register("stream_daily_quota", f"""SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS used, count(*) > 2 AS over
FROM events GROUP BY user_id, date_trunc('day', ts)""")
def stream_daily_quota(spark, d):
    out = closed(spark, d, lambda e: jobs.daily_quota(e, "user_id", 2))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@register("stream_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER w + INTERVAL 12 HOURS THEN 1 ELSE 0 END AS fresh FROM events
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS start, count(*) AS n FROM s GROUP BY user_id, s""")
def stream_sessions(spark, d):
    out = closed(spark, d, lambda e: jobs.sessions(e, "user_id"))
    return out.select("user_id", wall("start").alias("start"), "n")


@register("stream_sliding_activity", f"""WITH w AS (SELECT user_id, date_trunc('day', ts) + to_hours(CAST(6 * (floor(hour(ts) / 6) - i) AS BIGINT)) AS start
  FROM events, range(0, 4) AS g(i))
SELECT user_id, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM w GROUP BY 1, w.start""")
def stream_sliding(spark, d):
    out = closed(spark, d, lambda e: jobs.sliding_activity(e, "user_id"))
    return out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def _ledger_stream(events):
    """Rows that are no ledger rows have no delta; they still tell how far time has come."""
    size = F.ceil("value").cast("long")
    kind = F.col("event_type")
    delta = F.when(kind.isin("purchase", "signup"), size).when(kind != "error", -size)
    return events.select("user_id", "event_id", "ts", F.when(size > 0, delta).alias("delta"))


@register("stream_spend", f"{_REPLAY} SELECT user_id, event_id, delta, CAST(balance AS BIGINT) AS balance, accepted FROM r")
def stream_spend(spark, d):
    out = closed(spark, d, lambda e: timed.spends_in_time(_ledger_stream(e)))
    return out.select("user_id", "event_id", "delta", "balance", "accepted")


def _payloads(spark, d):
    """Purchases as payment messages of two shapes, each sent twice; other events as messages that are no payment."""
    e = jobs.event_stream(spark, d)
    paid = F.col("event_type") == "purchase"
    person = F.struct(F.col("user_id").cast("string").alias("user_id"), F.lit("pack_5").alias("pack_id"),
                      F.round("value", 2).alias("amount_usd"))
    ref = F.col("event_id").cast("string")
    a = F.to_json(F.struct(F.when(paid, jobs.PAID_A).otherwise("charge.failed").alias("event"),
                           F.struct(ref.alias("reference"), person.alias("metadata")).alias("data")))
    b = F.to_json(F.struct(F.struct(F.when(paid, jobs.PAID_B).otherwise("order_refunded").alias("event_name"),
                                    person.alias("custom_data")).alias("meta"), F.struct(ref.alias("id")).alias("data")))
    body = F.when(F.col("user_id") % 2 == 0, a).otherwise(b)
    return e.select("ts", F.explode(F.array(body, body)).alias("body"))


@register("stream_payments", """SELECT CASE WHEN user_id % 2 = 0 THEN 'paystack' ELSE 'lemonsqueezy' END AS gateway, CAST(event_id AS VARCHAR) AS reference,
  CAST(user_id AS VARCHAR) AS user_id, 'pack_5' AS pack_id, round(value, 2) AS amount_usd FROM events WHERE event_type = 'purchase'""")
def stream_payments(spark, d):
    return jobs.drain(jobs.payment_events(_payloads(spark, d), "body")).drop("ts")


@register("stream_allowances", """WITH RECURSIVE g AS (SELECT user_id, min(ts) AS at_ts FROM events GROUP BY 1
  UNION ALL SELECT user_id, nxt FROM (SELECT g.user_id, (SELECT min(e.ts) FROM events e WHERE e.user_id = g.user_id
    AND floor(epoch(e.ts)) - floor(epoch(g.at_ts)) >= 7 * 86400) AS nxt FROM g) WHERE nxt IS NOT NULL)
SELECT user_id AS enrolment, strftime(at_ts, '%Y-%m-%d %H:%M:%S') AS granted_at FROM g""")
def stream_allowances(spark, d):
    out = closed(spark, d, lambda e: timed.grants_in_time(e, "user_id", 7))
    return out.withColumn("granted_at", F.date_format("granted_at", "yyyy-MM-dd HH:mm:ss"))


_PROFILE = """SELECT 'value' AS variable, count(*) AS rows, count(value) AS filled, min(value) AS min, max(value) AS max, round(avg(value), 4) AS mean{0} FROM events
UNION ALL SELECT 'user_id', count(*), count(user_id), CAST(min(user_id) AS DOUBLE), CAST(max(user_id) AS DOUBLE), round(avg(user_id), 4){0} FROM events"""


def _near(out, events):
    """Whether a sketch's distinct count lies within three standard errors of the exact one."""
    exact = events.agg(*[F.countDistinct(c).alias(c) for c in ("value", "user_id")]).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("variable"), F.col(c).alias("exact")) for c in ("value", "user_id")])))
    near = F.abs(F.col("distinct") - F.col("exact")) <= 3 * 0.83 / 2 ** (profiles.LG / 2) * F.col("exact")
    return out.join(exact, "variable").withColumn("distinct_near", near).drop("distinct", "exact")


@register("stream_profile", _PROFILE.format(", true AS distinct_near"))
def stream_profile(spark, d):
    out = jobs.merge_profile(closed(spark, d, lambda e: jobs.profile_increments(e, ["value", "user_id"])))
    return _near(out.withColumn("mean", F.round("mean", 4)), spark.read.parquet(f"{d}/events.parquet"))


@register("stream_profile_kept", _PROFILE.format(", true AS distinct_near"))
def stream_profile_kept(spark, d):
    """The profile kept in a table, batch by batch."""
    folder = f"{checkpoint_folder(spark)}/profile-{uuid.uuid4().hex}"
    profiles.keep_profile(jobs.event_stream(spark, d), ["value", "user_id"], f"{folder}/table", f"{folder}/state").awaitTermination()
    out = profiles.read_profile(spark, f"{folder}/table")
    return _near(out.withColumn("mean", F.round("mean", 4)), spark.read.parquet(f"{d}/events.parquet"))
