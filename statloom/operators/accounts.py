"""Rosters, dashboards, share links and roll-ups over the account tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom import fixed_values as fv


def activity_counts(audit: DataFrame, user: str, action: str, actions: list[str] = fv.ACTIVITY_ACTIONS) -> DataFrame:
    return audit.where(F.col(action).isin(actions)).groupBy(F.col(user).alias("user_id")).agg(
        F.count("*").alias("analyses_run"))


def roster(enrolments: DataFrame, users: DataFrame, activity: DataFrame) -> DataFrame:
    """Enrolled students with contact and activity; students without a user row or activity stay."""
    out = enrolments.join(users, enrolments.student_id == users.id, "left").drop("id")
    out = out.join(activity, out.student_id == activity.user_id, "left").drop("user_id")
    return out.withColumns({"email": F.coalesce("email", F.lit("—")),
                            "analyses_run": F.coalesce("analyses_run", F.lit(0))})


def class_dashboard(classes: DataFrame, rosters: DataFrame) -> DataFrame:
    """Totals per class, classes without students included."""
    totals = rosters.groupBy("class_id").agg(
        F.count("*").alias("total_students"), F.count_if("is_active").alias("active_students"),
        F.sum("analyses_run").alias("total_analyses"))
    out = classes.join(totals, classes.id == totals.class_id, "left")
    return out.select("id", "class_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in
                                            ("total_students", "active_students", "total_analyses")])


def resolve_codes(requests: DataFrame, classes: DataFrame, code: str) -> DataFrame:
    """Class of each join code, upper-cased and trimmed."""
    wanted = requests.withColumn("_code", F.upper(F.trim(F.col(code))))
    return wanted.join(classes, F.col("_code") == F.col("class_code"), "left").drop("_code")


def valid_requests(requests: DataFrame) -> DataFrame:
    """Class requests with the reason of a rejection, null when the request is good."""
    name = F.trim("class_name")
    reason = (F.when(F.col("class_name").isNull() | (name == ""), "Class name is required.")
              .when(F.col("monthly_allowance") < 0, "Monthly allowance cannot be negative."))
    return requests.withColumn("reason", reason).withColumn("class_name", name)


def is_expired(expires: Column, now: Column) -> Column:
    """Naive texts are read as UTC; unreadable ones count as not expired."""
    return F.coalesce(F.try_to_timestamp(expires) < now, F.lit(False))


def share_links(analyses: DataFrame, key: str, created: Column) -> DataFrame:
    """Links with a 30-day life."""
    return analyses.select(F.col(key).alias("analysis_id"), created.alias("created_at"),
                           (created + F.expr(f"INTERVAL {fv.SHARE_LINK_DAYS} DAYS")).alias("expires_at"))


def view_counts(links: DataFrame, views: DataFrame, token: str) -> DataFrame:
    seen = views.groupBy(token).agg(F.count("*").alias("view_count"))
    return links.join(seen, token, "left").withColumn("view_count", F.coalesce("view_count", F.lit(0)))


def resolve_share(requests: DataFrame, links: DataFrame, analyses: DataFrame, now: Column) -> DataFrame:
    """Status per requested token: 404 unknown, 410 expired, 404 analysis gone, else 200."""
    out = requests.join(links, "token", "left").join(
        analyses.withColumn("_found", F.lit(True)), "analysis_id", "left")
    code = (F.when(F.col("analysis_id").isNull(), 404).when(F.col("expires_at") < now, 410)
            .when(F.col("_found").isNull(), 404).otherwise(200))
    return out.withColumn("code", code).drop("_found")


def orphan_links(links: DataFrame, analyses: DataFrame, key: str = "analysis_id") -> DataFrame:
    return links.join(analyses, key, "left_anti")


def filter_users(users: DataFrame, search: str = "", status: str = "all", plan: str = "all",
                 date_from: str = "", date_to: str = "") -> DataFrame:
    """The admin list's filters; empty or `all` leaves a filter out."""
    out = users
    if search:
        out = out.where(F.lower("email").contains(search.lower()))
    if status != "all":
        out = out.where(F.col("is_active") == F.lit(status == "active"))
    if plan != "all":
        out = out.where(F.col("plan") == plan)
    if date_from:
        out = out.where(F.col("created_at") >= F.lit(date_from))
    if date_to:
        out = out.where(F.col("created_at") <= F.lit(date_to))
    return out


def user_page(users: DataFrame, order: list[str], after: tuple | None = None, size: int = 25) -> DataFrame:
    """One page, newest first; `after` is the last row's key of the page before, so no rows are skipped over."""
    if after is not None:
        head = F.struct(*[F.col(o) for o in order])
        mark = F.struct(*[F.lit(v).alias(o) for o, v in zip(order, after)])
        users = users.where(head < mark)
    return users.orderBy(*[F.desc(o) for o in order]).limit(size)


def admin_kpis(users: DataFrame, audit: DataFrame, ledger: DataFrame, today: Column, subscriptions: DataFrame) -> DataFrame:
    """One row of totals; four independent aggregates meet as scalars. `subscriptions` has a row per user with its status."""
    spent = -F.sum(F.when(F.col("delta") < 0, F.col("delta")).otherwise(0))
    money = ledger.agg(F.struct(
        F.sum(F.when(F.col("delta") > 0, F.col("delta")).otherwise(0)).alias("sold"), spent.alias("consumed"),
        F.round(F.sum("amount_usd"), 2).alias("revenue")).alias("m")).scalar()
    # distinct users are counted through a grouped count, so no distinct set meets in one task
    active = audit.where(F.to_date("ts") == today).groupBy("user_id").agg(F.lit(1).alias("x")).agg(F.count("*")).scalar()
    running = subscriptions.agg(F.count_if(F.coalesce(F.col("status") == "active", F.lit(False)))).scalar()
    return users.agg(F.count("*").alias("total_users")).select(
        "total_users", active.alias("active_today"), money["sold"].alias("credits_sold"),
        money["consumed"].alias("credits_consumed"), money["revenue"].alias("revenue_usd"), running.alias("active_subscriptions"))


def user_detail(profiles: DataFrame, audit: DataFrame, balances: DataFrame, activity: DataFrame, subscriptions: DataFrame,
                newest: DataFrame) -> DataFrame:
    """A row per profile (user_id, created_at, is_active): balance, joined, status, subscription, last action, saved tests and
    the transactions of `newest` (user_id, rn, reason, delta; the newest few per user), newest first."""
    last = audit.groupBy("user_id").agg(F.max_by("action", F.struct("ts", "event_id")).alias("last_action"),
                                        F.max("ts").alias("last_activity_at"))
    plan = subscriptions.where("status IS NOT NULL").select("user_id", F.concat("plan", F.lit(" ("), "status", F.lit(")")).alias("subscription"))
    moves = newest.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rn", "reason", "delta"))).alias("transactions"))
    out = profiles
    for part in (last, balances, activity, plan, moves):
        out = out.join(part, "user_id", "left")
    return out.select("user_id", F.coalesce("balance", F.lit(0)).alias("balance"), F.to_date("created_at").alias("joined"),
                      F.when(F.col("is_active"), "Active").otherwise("Suspended").alias("status"),
                      F.coalesce("subscription", F.lit("None")).alias("subscription"), "last_action", "last_activity_at",
                      F.coalesce("analyses_run", F.lit(0)).alias("tests_saved"), "transactions")


def payments(ledger: DataFrame, order: list[str], limit: int = 50) -> DataFrame:
    """Newest paid rows with their kind."""
    kind = F.when(F.col("reason") == "subscription_grant", "Subscription").otherwise("Credit Pack")
    return (ledger.where(F.col("gateway").isNotNull()).withColumn("kind", kind)
            .orderBy(*[F.desc(o) for o in order]).limit(limit))


def referral_funnel(referrals: DataFrame) -> DataFrame:
    """Invited and qualified per referrer, milestones reached, and what is missing to the next one."""
    agg = referrals.groupBy("referrer").agg(F.count("*").alias("total_referred"),
                                            F.count_if("qualified").alias("qualified_count"))
    marks = F.array(*[F.struct(F.lit(t).alias("threshold"), F.lit(label).alias("label")) for t, label in fv.MILESTONES])
    reached = F.size(F.filter(marks, lambda m: m["threshold"] <= F.col("qualified_count")))
    ahead = F.get(F.filter(marks, lambda m: m["threshold"] > F.col("qualified_count")), F.lit(0))
    return agg.select("referrer", "total_referred", "qualified_count", reached.alias("milestones_reached"),
                      ahead["label"].alias("next_reward"),
                      (ahead["threshold"] - F.col("qualified_count")).alias("remaining"))


def audit_rows(audit: DataFrame, agent: str) -> DataFrame:
    return audit.withColumn(agent, F.substring(F.coalesce(F.col(agent), F.lit("")), 1, fv.USER_AGENT_LENGTH))


def audit_rollup(audit: DataFrame, action: str, ts: str) -> DataFrame:
    return audit.groupBy(F.col(action).alias("action"), F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))


def audit_details(audit: DataFrame, action: str, details: str, fields: dict[str, str]) -> DataFrame:
    """Every audit row with its action and the named fields of its JSON details; text that is no JSON, a missing field or one of another type gives null."""
    found = F.try_parse_json(F.col(details))
    return audit.select(F.col(action).alias("action"), *[F.try_variant_get(found, f"$.{f}", kind).alias(f) for f, kind in fields.items()])


def detail_fields(audit: DataFrame, action: str, details: str) -> DataFrame:
    """(action, field, type, n): the top-level fields that the details of each action hold, with their types; nothing needs to be known before."""
    parsed = audit.select(F.col(action).alias("action"), F.try_parse_json(F.col(details)).alias("_v"))
    fields = parsed.lateralJoin(audit.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    return fields.groupBy("action", F.col("key").alias("field"), F.schema_of_variant("value").alias("type")).agg(F.count("*").alias("n"))


def newest_first(df: DataFrame, order: list[str]) -> DataFrame:
    return df.orderBy(*[F.desc(o) for o in order])


def shared_contents(shared: DataFrame, charts: DataFrame) -> DataFrame:
    """Resolved links with their chart addresses, one row per chart; links without charts keep one row."""
    return shared.join(charts.select("analysis_id", "chart_url"), "analysis_id", "left")
