"""Qualification, promotion, lead lists, calling queues, call folds and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..refdata import LEAD_STATUSES, OUTCOME_STATUS
from ..storage import cut
from .ordering import ranked, window_starts, with_last

LEAST_CONFIDENCE = 70
#: Events of a key up to which its windows are folded in one expression.
FOLD = 500
MANUAL = ("REQUIRES_MANUAL_CHECK", "WEBSITE_UNCERTAIN", "IDENTITY_UNVERIFIED")
#: What a list can be sorted by: name -> column of the joined view.
SORT_KEYS = {
    "name": "name_lower", "city": "city", "category": "category", "identity": "identity_confidence", "website": "website_status",
    "website_confidence": "website_confidence", "status": "status_order", "assigned": "user_name", "priority": "priority", "calls": "call_count",
    "last_call": "last_call_ms", "callback": "next_callback_ms",
}


def status_table(spark: SparkSession) -> DataFrame:
    """The twelve lead statuses."""
    return spark.createDataFrame(list(LEAD_STATUSES), "key string, sort_order int, is_terminal boolean, is_callable boolean")


def qualify() -> Column:
    """struct(qualifies, reasons, blockers, label) of a business row; reasons and blockers are codes."""
    status, confidence = F.col("website_status"), F.coalesce(F.col("website_confidence"), F.lit(0))
    phone = F.coalesce(F.col("phone_e164"), F.lit("")) != ""
    site = (
        F.when(status == "VERIFIED_NO_WEBSITE", F.lit(None))
        .when(status.isin("VERIFIED_WEBSITE", "PROBABLE_WEBSITE"), "has_website")
        .when(status.isin("WEBSITE_UNCERTAIN", "REQUIRES_MANUAL_CHECK"), "manual_check")
        .when(status == "IDENTITY_UNVERIFIED", "website_identity")
        .otherwise("not_checked")
    )
    blockers = F.array_compact(F.array(
        F.when(F.col("excluded_ms").isNotNull(), "excluded"),
        F.when(F.col("identity_status") != "CONFIRMED", "identity_status"),
        F.when(F.col("identity_confidence") < LEAST_CONFIDENCE, "identity_confidence"),
        site,
        F.when((status == "VERIFIED_NO_WEBSITE") & (confidence < LEAST_CONFIDENCE), "website_confidence"),
        F.when(~phone, "no_phone"),
    ))
    reasons = F.array_compact(F.array(F.when(F.col("identity_status") == "CONFIRMED", "identity_confirmed"), F.when(status == "VERIFIED_NO_WEBSITE", "no_website"), F.when(phone, "callable_phone")))
    first = F.try_element_at(blockers, F.lit(1))
    label = (
        F.when(first.isNull(), "Qualifies").when(first == "has_website", "Has website").when(first == "manual_check", "Needs check").when(first == "no_phone", "No phone")
        .when(first.isin("identity_status", "identity_confidence", "website_identity"), "Identity").when(first == "excluded", "Excluded").when(first == "not_checked", "Not checked").otherwise("No")
    )
    return F.struct((F.size(blockers) == 0).alias("qualifies"), reasons.alias("reasons"), blockers.alias("blockers"), label.alias("label"))


def promote(businesses: DataFrame, leads: DataFrame, requested: DataFrame, as_of_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new leads, their first history rows, refused with blockers) for requested business ids (id, forced).

    Ids that are leads already are passed over; what does not qualify is
    refused unless forced, and then marked overridden.
    """
    wanted = requested.groupBy("id").agg(F.max("forced").alias("forced")).join(leads.select(F.col("business_id").alias("id")), "id", "left_anti")
    judged = businesses.withColumn("q", qualify()).join(wanted, "id").select("id", "forced", "q")
    taken = judged.where("q.qualifies or forced").select(F.sha2(F.concat(F.lit("lead|"), "id"), 256).substr(1, 16).alias("lead_id"), F.col("id").alias("business_id"), F.lit("new").alias("status"), (~F.col("q.qualifies")).alias("overridden"), F.lit(as_of_ms).cast("long").alias("created_ms"))
    history = taken.select("lead_id", F.lit(None).cast("string").alias("from_status"), F.lit("new").alias("to_status"), "created_ms")
    return taken, history, judged.where("not (q.qualifies or forced)").select("id", "q.blockers")


def exclude(businesses: DataFrame, leads: DataFrame, ids: DataFrame, as_of_ms: int) -> tuple[DataFrame, DataFrame]:
    """Businesses with the given ids (id, reason; a null reason restores) marked excluded, and the leads that are left."""
    own = ids.groupBy("id").agg(F.max("reason").alias("reason")).withColumn("asked", F.lit(True))  # of several requests a reason wins
    df = businesses.drop("exclusion_reason").join(own.withColumnRenamed("reason", "exclusion_reason"), "id", "left")
    out = df.withColumn("excluded_ms", F.when(F.col("asked") & F.col("exclusion_reason").isNotNull(), F.lit(as_of_ms).cast("long")).when(F.col("asked"), F.lit(None).cast("long")).otherwise(F.col("excluded_ms"))).drop("asked")
    return out, leads.join(own.where("reason is not null").select(F.col("id").alias("business_id")), "business_id", "left_anti")


def lead_view(businesses: DataFrame, leads: DataFrame, users: DataFrame) -> DataFrame:
    """Businesses with their leads, statuses and users; the two small dimensions are left to the optimiser to broadcast."""
    l = leads.select(F.col("lead_id"), F.col("business_id").alias("id"), F.col("status").alias("lead_status"), "assigned_user_id", "priority", "call_count", "last_call_ms", "next_callback_ms")  # noqa: E741
    s = status_table(businesses.sparkSession).select(F.col("key").alias("lead_status"), F.col("sort_order").alias("status_order"), "is_terminal", "is_callable")
    u = users.select(F.col("user_id").alias("assigned_user_id"), F.col("user_name"))
    return businesses.join(l, "id", "left").join(s, "lead_status", "left").join(u, "assigned_user_id", "left").withColumn("name_lower", F.lower("name"))


def list_filter(
    as_of_ms: int, *, scope: str = "pool", include_excluded: bool = False, include_demo: bool = True, search: str | None = None, website_status: Sequence[str] = (), identity_status: Sequence[str] = (),
    lead_status: Sequence[str] = (), assigned: str | None = None, category: str | None = None, city_key: str | None = None, qualified_only: bool = False, needs_manual_check: bool = False, uncalled: bool = False, callback_due: bool = False,
) -> Column:
    """One predicate over ``lead_view``. The search is literal (no wildcards), in name, city, street, phone and postal code."""
    parts: list[Column] = [F.lit(True)]
    if scope == "leads":
        parts.append(F.col("lead_id").isNotNull())
    if not include_excluded:
        parts.append(F.col("excluded_ms").isNull())
    if not include_demo:
        parts.append(~F.col("is_demo"))
    if search and search.strip():
        needle = F.lit(search.strip().lower())
        hit = F.lit(False)
        for c in ("name", "city", "street", "phone_e164", "postal_code"):
            hit = hit | F.coalesce(F.contains(F.lower(c), needle), F.lit(False))
        parts.append(hit)
    for values, c in ((website_status, "website_status"), (identity_status, "identity_status"), (lead_status, "lead_status")):
        if values:
            parts.append(F.col(c).isin(*values))
    if assigned == "unassigned":
        parts.append(F.col("assigned_user_id").isNull())
    elif assigned:
        parts.append(F.col("assigned_user_id") == assigned)
    if category:
        parts.append(F.col("category") == category)
    if city_key:
        parts.append(F.col("city_key") == city_key)
    if qualified_only:
        parts += [F.col("website_status") == "VERIFIED_NO_WEBSITE", F.col("identity_status") == "CONFIRMED", F.col("phone_e164").isNotNull()]
    if needs_manual_check:
        parts.append(F.col("website_status").isin(*MANUAL))
    if uncalled:
        parts.append(F.coalesce(F.col("call_count"), F.lit(0)) == 0)
    if callback_due:
        parts.append(F.col("next_callback_ms") <= as_of_ms)
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def page_of(view: DataFrame, sort: str = "name", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page: by the sort key with nulls last, then name and id; 1 to 500 rows."""
    c = F.col(SORT_KEYS.get(sort, "name_lower"))
    return view.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "name_lower", "id").offset(max(0, offset)).limit(min(500, max(1, limit)))


def _queue_order(as_of_ms: int) -> list[Column]:
    due = F.coalesce(F.col("next_callback_ms") <= as_of_ms, F.lit(False))
    return [F.when(due, 0).otherwise(1), F.desc("priority"), F.col("call_count"), F.coalesce(F.col("last_call_ms"), F.lit(0)), F.col("name_lower"), F.col("id")]


def _callable(view: DataFrame, as_of_ms: int) -> DataFrame:
    return view.where(F.col("lead_id").isNotNull() & F.col("excluded_ms").isNull() & F.col("phone_e164").isNotNull() & F.col("is_callable") & (F.col("next_callback_ms").isNull() | (F.col("next_callback_ms") <= as_of_ms)))


def calling_queue(view: DataFrame, user_id: str, as_of_ms: int, limit: int = 50) -> DataFrame:
    """What a user calls next: due callbacks, then own, unassigned and others' leads, by priority, calls, last call and name."""
    own = F.when(F.col("assigned_user_id") == user_id, 0).when(F.col("assigned_user_id").isNull(), 1).otherwise(2)
    due, *rest = _queue_order(as_of_ms)
    return _callable(view, as_of_ms).orderBy(due, own, *rest).limit(limit)


def all_queues(view: DataFrame, users: DataFrame, as_of_ms: int, limit: int = 50) -> DataFrame:
    """Every user's queue (user_id, rank, id).

    A queue's first rows are among the first rows of each (due, assigned user)
    group, so leads are cut to these groups' tops: own leads by key, the
    unassigned top once for all, and of the others the overall top of
    ``limit`` plus what the user's own may displace. The last two are a few
    rows in all, which every user gets as they are; a user's lists, each in
    order, follow one another, so nothing is sorted for a user.
    """
    due, *rest = _queue_order(as_of_ms)
    rows = _callable(view, as_of_ms).select("id", "assigned_user_id", "priority", "call_count", "last_call_ms", "name_lower", due.alias("due"))
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))
    listed = lambda: F.array_sort(F.collect_list(F.struct("due", "k", "id", "assigned_user_id")))
    top = rows.where("assigned_user_id is not null").withColumn("k", place("due", "assigned_user_id")).where(F.col("k") <= limit)
    own = top.groupBy(F.col("assigned_user_id").alias("user_id")).agg(listed().alias("own"))

    def firsts(of: DataFrame, n: int) -> DataFrame:
        """The first ``n`` rows of each ``due``; every task keeps its first ones."""
        each = [of.where(F.col("due") == d).orderBy(*rest).limit(n) for d in (0, 1)]
        return each[0].unionByName(each[1]).withColumn("k", place("due"))

    free = firsts(rows.where("assigned_user_id is null"), limit).agg(listed().alias("free"))
    taken = firsts(rows.where("assigned_user_id is not null"), 2 * limit).agg(listed().alias("taken"))
    common = free.crossJoin(taken)
    u = users.select("user_id").join(own, "user_id", "left").crossJoin(F.broadcast(common))
    none = F.array().cast("array<struct<due:int,k:int,id:string,assigned_user_id:string>>")
    part = lambda c, d: F.filter(F.coalesce(F.col(c), none), lambda x: x["due"] == d)
    others = lambda d: F.filter(F.col("taken"), lambda x: (x["due"] == d) & (x["assigned_user_id"] != F.col("user_id")))
    queue = F.slice(F.concat(*[x for d in (0, 1) for x in (part("own", d), part("free", d), others(d))]), 1, limit)
    return u.select("user_id", F.posexplode(queue).alias("at", "x")).select("user_id", (F.col("at") + 1).alias("rank"), "x.id")


def fold_calls(calls: DataFrame) -> DataFrame:
    """Lead counters from the call log: attempts, last call and caller, and the last callback recorded."""
    callback = F.when(F.col("callback_ms").isNotNull(), F.struct("updated_ms", "call_id"))
    return calls.groupBy("lead_id").agg(F.count("*").alias("call_count"), F.max("started_ms").alias("last_call_ms"), F.max_by("user_id", F.struct("started_ms", "call_id")).alias("last_call_by"), F.max_by("callback_ms", callback).alias("next_callback_ms"))


def status_after_call(calls: DataFrame) -> DataFrame:
    """Each call with the lead status it sets: an explicit one, else the outcome's, else ``called`` on a fresh lead."""
    table = F.create_map(*[F.lit(x) for pair in OUTCOME_STATUS.items() for x in pair])
    fresh = F.when(F.col("lead_status").isin("new", "ready_to_call"), "called").otherwise(F.col("lead_status"))
    return calls.withColumn("new_status", F.coalesce("explicit_status", F.try_element_at(table, F.col("outcome")), fresh))


def status_history(changes: DataFrame) -> DataFrame:
    """Transitions of each lead: from the previous status (null at first) to the new one, in time order."""
    return changes.withColumn("from_status", F.lag("to_status").over(Window.partitionBy("lead_id").orderBy("created_ms", "change_id")))


def funnel(businesses: DataFrame, leads: DataFrame) -> DataFrame:
    """One row: researched, qualified, to check by hand; leads, callable, with callback, interested, converted."""
    b = businesses.where("excluded_ms is null").agg(
        F.count("*").alias("researched"),
        F.count_if((F.col("website_status") == "VERIFIED_NO_WEBSITE") & (F.col("identity_status") == "CONFIRMED") & F.col("phone_e164").isNotNull()).alias("qualified"),
        F.count_if(F.col("website_status").isin(*MANUAL)).alias("manual_check"),
    )
    s = status_table(leads.sparkSession).select(F.col("key").alias("status"), "is_callable")
    l = leads.join(s, "status", "left").agg(  # noqa: E741
        F.count("*").alias("leads"), F.count_if("is_callable").alias("callable"), F.count_if(F.col("next_callback_ms").isNotNull()).alias("callbacks"), F.count_if(F.col("status") == "interested").alias("interested"), F.count_if(F.col("status") == "converted").alias("converted")
    )
    return b.join(l, F.lit(True))


def team_activity(users: DataFrame, calls: DataFrame, leads: DataFrame, as_of_ms: int) -> DataFrame:
    """Calls in a day and in a week and leads assigned, for every active user, zeros where none; by lower name."""
    day = 86_400_000
    c = calls.where(F.col("started_ms") >= as_of_ms - 7 * day).groupBy("user_id").agg(F.count_if(F.col("started_ms") >= as_of_ms - day).alias("calls_24h"), F.count("*").alias("calls_7d"))
    a = leads.where("assigned_user_id is not null").groupBy(F.col("assigned_user_id").alias("user_id")).agg(F.count("*").alias("assigned"))
    out = users.where("is_active").join(c, "user_id", "left").join(a, "user_id", "left").na.fill(0, ["calls_24h", "calls_7d", "assigned"])
    return out.select("user_id", "user_name", "calls_24h", "calls_7d", "assigned").orderBy(F.lower("user_name"), "user_id")


def metered_usage(uses: DataFrame, limit: int) -> DataFrame:
    """Each use with its UTC month, its number in it, and whether it is allowed; refused uses count too.

    Uses are numbered within an hour, and the hours' sums before it are added,
    so a provider's month is not one task's.
    """
    at = F.timestamp_millis("ts_ms")
    df = uses.withColumns({"period": F.date_format(at, "yyyy-MM"), "hour": F.floor(F.col("ts_ms") / 3_600_000)})
    hours = df.groupBy("provider", "period", "hour").agg(F.count("*").alias("n"))
    before = hours.withColumn("before", F.sum("n").over(Window.partitionBy("provider", "period").orderBy("hour")) - F.col("n")).drop("n")
    own = df.withColumn("own", F.row_number().over(Window.partitionBy("provider", "period", "hour").orderBy("ts_ms", "use_id")))
    return own.join(before, ["provider", "period", "hour"]).withColumn("nth", F.col("own") + F.col("before")).withColumn("allowed", F.col("nth") <= limit).drop("hour", "own", "before")


def monthly_usage(uses: DataFrame) -> DataFrame:
    """Uses of each provider and month, by partial aggregation."""
    return uses.groupBy("provider", F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM").alias("period")).agg(F.count("*").alias("uses"))


def admissions(events: DataFrame, limit: int, window_ms: int, fold: int = FOLD) -> DataFrame:
    """Fixed windows that open at a key's first event after the last one ended; the first ``limit`` events of a window are admitted.

    The window's start hangs on the data. Keys with at most ``fold`` events
    are folded in one expression each; the others' windows are found by
    doubling pointers over their sorted times (``window_starts``), which
    never holds a key in one task. Both ways give the same rows. Rows with a
    null key are one key's; null times have no window and are left out.
    """
    named = events.where("ts_ms is not null").select(F.struct("key").alias("key"), "ts_ms", "event_id")  # a struct is never null
    sizes = cut(named.groupBy("key").agg(F.count("*").alias("size")))
    small = _folded(named.join(sizes.where(F.col("size") <= fold).select("key"), "key"), limit, window_ms)
    if not sizes.where(F.col("size") > fold).limit(1).count():
        return small.select("key.key", *small.columns[1:])
    large = cut(named.join(sizes.where(F.col("size") > fold).select("key"), "key"))
    starts = window_starts(large.select("key", F.col("ts_ms").alias("at")).distinct(), window_ms)
    placed = ranked(with_last(large, starts, "ts_ms"), ["key", "start"], ["ts_ms", "event_id"])
    ok, n = F.col("k") < limit, F.col("k") + 1
    rows = placed.select("key", "ts_ms", "event_id", ok.alias("allowed"), F.greatest(F.lit(0), limit - n).cast("int").alias("remaining"), F.when(ok, 0).otherwise(F.col("start") + window_ms - F.col("ts_ms")).cast("long").alias("retry_after_ms"))
    return small.unionByName(rows).select("key.key", *rows.columns[1:])


def _folded(events: DataFrame, limit: int, window_ms: int) -> DataFrame:
    """``admissions`` of keys with few events: their sorted times are folded to the windows' starts and numbers, one after the other."""
    state = "struct<reset:long,n:int,out:array<struct<ts_ms:long,event_id:long,allowed:boolean,remaining:int,retry_after_ms:long>>>"
    empty = F.expr(f"cast(named_struct('reset', cast(null as bigint), 'n', 0, 'out', array()) as {state})")

    def step(acc: Column, e: Column) -> Column:
        fresh = acc["reset"].isNull() | (e["ts_ms"] >= acc["reset"])
        reset, n = F.when(fresh, e["ts_ms"] + window_ms).otherwise(acc["reset"]), F.when(fresh, 1).otherwise(acc["n"] + 1)
        ok = n <= limit
        row = F.struct(e["ts_ms"].alias("ts_ms"), e["event_id"].alias("event_id"), ok.alias("allowed"), F.greatest(F.lit(0), limit - n).cast("int").alias("remaining"), F.when(ok, 0).otherwise(reset - e["ts_ms"]).cast("long").alias("retry_after_ms"))
        return F.struct(reset.cast("long").alias("reset"), n.cast("int").alias("n"), F.concat(acc["out"], F.array(row)).alias("out")).cast(state)

    folded = events.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ts_ms", "event_id"))).alias("own")).select("key", F.aggregate("own", empty, step)["out"].alias("out"))
    return folded.select("key", F.explode("out").alias("x")).select("key", "x.*")


def run_statistics(items: DataFrame, checks: DataFrame | None = None) -> DataFrame:
    """Counters of each run from its records' outcomes and, where ``checks`` (run_id, failed, qualifies) are given, from its verifications.

    ``items``: run_id, outcome and conflict (a record that met a business with
    another phone or postal code). A rejected record is excluded; a matched
    record with a conflict is a duplicate and needs review; a refreshed one
    with a conflict is refreshed and needs review.
    """
    is_ = lambda *names: F.col("outcome").isin(*names)
    conflict = F.coalesce(F.col("conflict"), F.lit(False))
    out = items.groupBy("run_id").agg(
        F.count("*").alias("found"), F.count_if(is_("new")).alias("n_new"), F.count_if(is_("duplicate") | (is_("needs_review") & conflict)).alias("n_duplicate"), F.count_if(is_("refreshed")).alias("n_refreshed"),
        F.count_if(is_("needs_review") | (is_("refreshed", "duplicate") & conflict)).alias("n_needs_review"), F.count_if(is_("rejected", "excluded")).alias("n_excluded"),
    )
    if checks is None:
        return out
    done = checks.groupBy("run_id").agg(F.count_if(~F.col("failed")).alias("verified"), F.count_if("failed").alias("verification_failures"), F.count_if(~F.col("failed") & F.col("qualifies")).alias("qualified"))
    return out.join(done, "run_id", "left").na.fill(0, ["verified", "verification_failures", "qualified"])


def with_users(rows: DataFrame, users: DataFrame, ts: str = "created_ms", tie: str = "change_id", n: int | None = None) -> DataFrame:
    """Calls, notes, changes or audit rows with the user's name; with ``n`` the newest ones, newest first."""
    own = rows if n is None else newest(rows, n, ts, tie)
    named = own.join(users.select("user_id", "user_name"), "user_id", "left")
    return named if n is None else named.orderBy(F.desc(ts), F.desc(tie))


def calls_since(calls: DataFrame, users: DataFrame, since_ms: int) -> DataFrame:
    """One row: calls that started at or after an instant, and active users."""
    c = calls.where(F.col("started_ms") >= since_ms).agg(F.count("*").alias("calls"))
    return c.join(users.where("is_active").agg(F.count("*").alias("active_users")), F.lit(True))


def latest_per(rows: DataFrame, key: str, order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= n)


def newest(rows: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def stale(businesses: DataFrame, as_of_ms: int, ttl_days: int = 30) -> DataFrame:
    """Never checked, or checked longer ago than the limit."""
    return businesses.where(F.col("checked_ms").isNull() | (F.lit(as_of_ms) - F.col("checked_ms") > ttl_days * 86_400_000))


def manual_overlay(computed: DataFrame, manual: DataFrame) -> DataFrame:
    """The newest verification of each business, computed or made by hand; a verdict that there is a site needs its address."""
    valid = manual.where("status <> 'VERIFIED_WEBSITE' or url is not null").withColumn("confidence", F.lit(100))
    both = computed.withColumn("by_hand", F.lit(False)).unionByName(valid.withColumn("by_hand", F.lit(True)), allowMissingColumns=True)
    return latest_per(both, "business_id", [F.desc("finished_ms"), F.desc("by_hand"), F.desc("verification_id")]).drop("rn")
