"""Credit ledger, quotas, allowances and prices as whole-table jobs."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statloom import fixed_values as fv
from statloom.functions.scalars import format_price
from statloom.operators.asof import last_known
from statloom.operators.prefix import in_units, running_sum
from statloom.session import literal_rows, settle


def lookup(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A fixed lookup table as a broadcastable frame; its size is the length of a constant."""
    return F.broadcast(literal_rows(spark, rows, schema))


def entry_rows(df: DataFrame, user: str, action: str, amount: str, grants: list[str], spends: list[str],
               keep: list[str]) -> DataFrame:
    """Ledger rows with a signed delta; amounts that are not positive and unknown actions make no row."""
    size = F.when(F.col(amount) > 0, F.col(amount).cast("long"))
    delta = F.when(F.col(action).isin(grants), size).when(F.col(action).isin(spends), -size)
    return df.select(F.col(user).alias("user_id"), *keep, F.col(action).alias("reason"),
                     delta.alias("delta")).where("delta IS NOT NULL")


def running_balance(ledger: DataFrame, user: str = "user_id", ts: str = "ts", tie: list[str] = ("event_id",),
                    delta: str = "delta") -> DataFrame:
    return running_sum(ledger, [user], ts, list(tie), F.col(delta), "balance")


def latest_balance(balances: DataFrame, user: str = "user_id", order: list[str] = ("ts", "event_id")) -> DataFrame:
    """Balance of the newest row per user; a combining aggregate, no sort."""
    return balances.groupBy(user).agg(F.max_by("balance", F.struct(*order)).alias("balance"))


def history(ledger: DataFrame, user: str, order: list[str], limit: int = 50) -> DataFrame:
    """Newest rows per user; rows beyond the limit are dropped before the shuffle (window group limit)."""
    newest = Window.partitionBy(user).orderBy(*[F.desc(o) for o in order])
    return ledger.withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= limit)


def audit_balances(ledger: DataFrame, stored: str, user: str, ts: str, tie: list[str], delta: str) -> DataFrame:
    """Rows whose stored balance is not the running sum of the deltas."""
    checked = running_sum(ledger, [user], ts, tie, F.col(delta), "_expected")
    return checked.where(~F.col("_expected").eqNullSafe(F.col(stored))).withColumnRenamed("_expected", "expected")


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fold in time order over rows sorted by user; only the current user's balance is held."""
    user, balance = None, 0
    for pdf in batches:
        after, ok, short = [], [], []
        for who, delta in zip(pdf["user_id"].to_numpy(), pdf["delta"].to_numpy()):
            if who != user:
                user, balance = who, 0
            fits = delta >= 0 or balance + delta >= 0
            short.append(0 if fits else int(-delta - balance))
            balance += int(delta) if fits else 0
            after.append(balance)
            ok.append(fits)
        yield pdf.assign(balance=after, accepted=ok, shortfall=short)


def replay_spends(ledger: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """Accept a spend only while the balance covers it; rejected rows leave the balance unchanged.

    Each decision depends on the one before it, so a user's rows stay in order in one sorted stream. Rows pass
    through in Arrow batches with one number carried over, so a user of any size needs no more memory. `replay_by_need` gives
    the same in many tasks per user.
    """
    rows = ledger.select("user_id", ts, tie, F.col("delta").cast("long").alias("delta"))
    types = dict(rows.dtypes)
    schema = (f"user_id {types['user_id']}, {ts} {types[ts]}, {tie} {types[tie]}, delta long, balance long, "
              "accepted boolean, shortfall long")
    return rows.repartition("user_id").sortWithinPartitions("user_id", ts, tie).mapInPandas(_replay, schema)


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Balance with which each unit of an account begins. Units come in order, calm ones as their sum alone, others row by row."""
    now, unit, balance = None, None, 0
    for batch in batches:
        out = []
        for missing, user, of, calm, delta in zip(*(c.to_pylist() for c in batch.columns)):
            if now != (missing, user):
                now, unit, balance = (missing, user), None, 0
            if of != unit:
                unit = of
                out.append((missing, user, of, balance))
            if calm or delta >= 0 or balance + delta >= 0:
                balance += delta
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.bool_(), pa.string(), pa.int64(), pa.int64()))],
                                         names=["_none", "_user", "_unit", "_begin"])


def _replay_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fold within units whose first balance is known; rows come in order."""
    now, balance = None, 0
    for batch in batches:
        after, ok, short = [], [], []
        places = [batch.schema.get_field_index(c) for c in ("_none", "_user", "_unit", "_begin", "delta")]
        for *unit, begin, delta in zip(*(batch.column(i).to_pylist() for i in places)):
            if now != unit:
                now, balance = unit, begin
            fits = delta >= 0 or balance + delta >= 0
            short.append(0 if fits else -delta - balance)
            balance += delta if fits else 0
            after.append(balance)
            ok.append(fits)
        keep = [i for i, n in enumerate(batch.schema.names) if n not in ("_none", "_user", "_unit", "_begin", "_at")]
        yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + [pa.array(after, pa.int64()), pa.array(ok, pa.bool_()), pa.array(short, pa.int64())],
                                         names=[batch.schema.names[i] for i in keep] + ["balance", "accepted", "shortfall"])


def replay_by_need(ledger: DataFrame, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The same result with the ordered fold kept to the runs of rows in which a spend may be rejected.

    The ledger is written in order and cut into units, short runs of one account's rows. Each is reduced to its sum and its least prefix sum. A balance
    that is cut off at zero instead of rejecting spends is never above the true one and is a prefix minimum of the sums; where it
    covers a unit's least prefix nothing is rejected there. Accounts without a doubtful unit are settled by sums. In the others one pass per
    account adds up calm units by their sum and folds the rows of doubtful ones, which tells the balance at the start of each unit; then all units,
    doubtful ones included, are finished side by side. Nulls: see `running_sum`; a null delta changes nothing.
    """
    delta = F.coalesce(F.col("delta").cast("long"), F.lit(0).cast("long"))
    rows = in_units(ledger.select("user_id", ts, tie, delta.alias("delta")), ["user_id", ts, tie, "delta"])
    rows = rows.withColumns({"_none": F.col("user_id").isNull(), "_user": F.coalesce(F.col("user_id").cast("string"), F.lit(""))})
    unit, account = ["_none", "_user", "_unit"], ["_none", "_user"]
    inside = Window.partitionBy(*unit).orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    units = rows.withColumn("_run", F.sum("delta").over(inside)).groupBy(*unit).agg(F.sum("delta").alias("_sum"), F.min("_run").alias("_low"))
    earlier = Window.partitionBy(*account).orderBy("_unit").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("_in", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    units = units.withColumn("_dip", F.coalesce(F.min(F.col("_in") + F.col("_low")).over(earlier), F.lit(0)))
    calm = F.col("_in") - F.least(F.lit(0), F.col("_dip")) + F.least(F.lit(0), F.col("_low")) >= 0
    units = settle(units.withColumn("_calm", calm))
    doubtful = settle(units.where("NOT _calm").select(*account).distinct())
    settled = units.join(doubtful, account, "left_anti").select(*unit, "_calm", F.col("_in").alias("_begin"))
    open_ = units.join(doubtful, account, "left_semi")
    sums = open_.where("_calm").select(*account, "_unit", F.lit(True).alias("_calm"), F.col("_sum").alias("delta"), F.lit(0).cast("long").alias("_at"))
    single = rows.join(open_.where("NOT _calm").select(*unit), unit, "left_semi").select(*account, "_unit", F.lit(False).alias("_calm"), "delta", "_at")
    chain = sums.unionByName(single).repartition(*account).sortWithinPartitions(*account, "_unit", "_at").drop("_at")
    begins = chain.mapInArrow(_starts, "_none boolean, _user string, _unit long, _begin long")
    begins = settle(settled.unionByName(begins.join(open_.select(*unit, "_calm"), unit)))
    met = rows.join(begins, unit)
    easy = met.where("_calm").select("user_id", ts, tie, "delta", (F.col("_begin") + F.sum("delta").over(inside)).alias("balance"),
                                     F.lit(True).alias("accepted"), F.lit(0).cast("long").alias("shortfall"))
    hard = met.where("NOT _calm").select("user_id", ts, tie, "delta", *unit, "_begin", "_at").repartition(*unit).sortWithinPartitions(*unit, "_at")
    types = dict(rows.dtypes)
    schema = f"user_id {types['user_id']}, `{ts}` {types[ts]}, `{tie}` {types[tie]}, delta long, balance long, accepted boolean, shortfall long"
    return easy.unionByName(hard.mapInArrow(_replay_units, schema))


def charge(requests: DataFrame, analysis: str, predictors: Column, role: Column, user: Column) -> DataFrame:
    """Credit cost of every request and whether it may go on without looking at the balance."""
    spark = requests.sparkSession
    prices = lookup(spark, [(k, c) for k, _, c in fv.PRICES], "price_key string, credits int")
    key = F.when((F.col(analysis) == "regression") & (predictors > 1), "multiple_regression").otherwise(F.col(analysis))
    priced = requests.withColumn("_key", key).join(prices, F.col("_key") == F.col("price_key"), "left")
    cost = F.coalesce("credits", F.lit(0))
    covered = (cost > 0) & (role == "professional_subscriber")
    return (priced.withColumn("cost", F.when(covered, 0).otherwise(cost))
            .withColumn("decision", F.when(cost == 0, "free").when(covered, "covered")
                        .when(user.isNull(), "signin_required").otherwise("charge"))
            .drop("_key", "price_key", "credits"))


def price_table(spark: SparkSession) -> DataFrame:
    rows = [(i, k, label, c) for i, (k, label, c) in enumerate(fv.PRICES)]
    table = literal_rows(spark, rows, "position int, key string, label string, credits int")
    return table.select("position", "key", "label", "credits", F.col("credits").alias("usd"),
                        (F.col("credits") == 0).alias("free"))


def convert(amounts: DataFrame, usd: str, currency: str) -> DataFrame:
    """Local amount by the rate table; unknown currencies keep a rate of one."""
    rates = lookup(amounts.sparkSession, fv.RATES, "_cur string, _rate double")
    code = F.upper(F.col(currency))
    joined = amounts.join(rates, code == F.col("_cur"), "left").withColumn("rate", F.coalesce("_rate", F.lit(1.0)))
    raw = F.col(usd) * F.col("rate")
    return joined.withColumn("converted", F.when(code == "NGN", F.bround(raw, 0)).otherwise(F.bround(raw, 2))
                             ).drop("_cur", "_rate")


def priced_text(amounts: DataFrame, usd: str, currency: str) -> DataFrame:
    prefix = lookup(amounts.sparkSession, fv.CURRENCY_PREFIX, "_pc string, _prefix string")
    code = F.upper(F.col(currency))
    out = convert(amounts, usd, currency).join(prefix, code == F.col("_pc"), "left")
    return out.withColumn("price", format_price(F.col(usd), code, F.col("converted"), F.col("_prefix"))
                          ).drop("_pc", "_prefix")


def country_settings(df: DataFrame, country: str) -> DataFrame:
    table = lookup(df.sparkSession, fv.COUNTRIES, "_cc string, currency string, gateway string")
    out = df.join(table, F.upper(F.col(country)) == F.col("_cc"), "left").drop("_cc")
    return out.withColumns({"currency": F.coalesce("currency", F.lit(fv.DEFAULT_COUNTRY[0])),
                            "gateway": F.coalesce("gateway", F.lit(fv.DEFAULT_COUNTRY[1]))})


def packs(df: DataFrame, pack: str) -> DataFrame:
    """Pack of each purchase; unknown packs keep null columns."""
    table = lookup(df.sparkSession, fv.PACKS, "_pack string, credits int, usd int, label string")
    return df.join(table, F.col(pack) == F.col("_pack"), "left").drop("_pack").withColumn(
        "saving", F.col("credits") - F.col("usd"))


def daily_quota(events: DataFrame, key: str, ts: str, tie: list[str], limit: int = fv.MAX_DOWNLOADS_PER_DAY) -> DataFrame:
    """Position of every event in its key's day, whether it is still allowed, and what is left."""
    day = events.withColumn("day", F.to_date(ts))
    ranked = running_sum(day, [key, "day"], ts, tie, F.lit(1).cast("long"), "used")
    return ranked.withColumn("allowed", F.col("used") <= limit).withColumn(
        "remaining", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)))


def monthly_usage(events: DataFrame, user: str, ts: str, plan: Column) -> DataFrame:
    """Rows per user and month against the plan's monthly allowance; -1 means unlimited."""
    plans = lookup(events.sparkSession, [(k, n) for k, _, n in fv.PLANS], "plan string, monthly_limit int")
    used = events.groupBy(F.col(user).alias("user_id"), F.date_trunc("month", F.col(ts)).alias("month")).agg(
        F.count("*").alias("used"))
    out = used.withColumn("plan", plan).join(plans, "plan", "left")
    within = (F.col("monthly_limit") == -1) | (F.col("used") <= F.col("monthly_limit"))
    return out.withColumn("within_plan", F.coalesce(within, F.lit(False)))


def due_allowances(enrolments: DataFrame, classes: DataFrame, now: Column) -> DataFrame:
    """Enrolments whose 30 whole days are over (or that never had a grant), class and enrolment both active.

    `classes` is joined without a forced broadcast; the size decides.
    """
    days = F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.col("last_allowance_at").cast("timestamp"))) / 86400)
    due = F.col("last_allowance_at").isNull() | (days >= fv.ALLOWANCE_PERIOD_DAYS)
    live = classes.where("is_active").select(F.col("id").alias("class_id"), "monthly_allowance")
    return (enrolments.where(F.col("is_active") & due).join(live, "class_id")
            .select("enrolment_id", "class_id", "student_id", F.col("monthly_allowance").alias("granted"))
            .where("granted > 0"))


def due_on_days(enrolments: DataFrame, classes: DataFrame, grants: DataFrame, days: list[str]) -> DataFrame:
    """(day, enrolment_id, class_id, student_id, granted): the allowances that were due on each of the days, from the history of grants
    (student_id, last_allowance_at), in one job."""
    asked = enrolments.drop("last_allowance_at").withColumn("day", F.explode(F.array(*[F.lit(d).cast("timestamp") for d in days])))
    history = grants.select("student_id", F.col("last_allowance_at").cast("timestamp").alias("day"), F.col("last_allowance_at").cast("timestamp").alias("last_allowance_at"))
    known = last_known(asked, history, ["student_id"], "day", ["last_allowance_at"], bucket="month")
    rows = due_allowances(known.withColumn("enrolment_id", F.struct("day", "enrolment_id")), classes, F.col("day"))
    return rows.select("enrolment_id.day", "enrolment_id.enrolment_id", "class_id", "student_id", "granted")


def current_state(changes: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """Latest value of each field over the change rows of a key; null fields leave the older value standing."""
    return changes.groupBy(key).agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields])
