"""Queries of qualification, lists, queues, folds, reports and history."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import leads as op
from ..refdata import LEAD_STATUSES, OUTCOME_STATUS
from ..sources.records import read_verifications, run_items, upsert, write_verifications
from ..storage import shared_folder, stored
from . import sqltext as q
from .catalog import query
from .standins import AS_OF, view, with_views

DAY = 86_400_000
STATUSES = "s AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {n}, {str(t).lower()}, {str(c).lower()})" for k, n, t, c in LEAD_STATUSES) + ") t(key, sort_order, is_terminal, is_callable))"
VIEW = f"{with_views('v_business', 'v_lead', 'v_user')}, {STATUSES}, lv AS (SELECT b.*, l.lead_id, l.status AS lead_status, l.assigned_user_id, l.priority, l.call_count, l.last_call_ms, l.next_callback_ms, s.sort_order AS status_order, s.is_callable, u.user_name, lower(b.name) AS name_lower FROM v_business b LEFT JOIN v_lead l ON l.business_id = b.id LEFT JOIN s ON s.key = l.status LEFT JOIN v_user u ON u.user_id = l.assigned_user_id) "


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.lead_view(view(spark, sf_dir, "v_business"), view(spark, sf_dir, "v_lead"), view(spark, sf_dir, "v_user"))


BLOCKERS = "list_filter([CASE WHEN excluded_ms IS NOT NULL THEN 'excluded' END, CASE WHEN identity_status <> 'CONFIRMED' THEN 'identity_status' END, CASE WHEN identity_confidence < 70 THEN 'identity_confidence' END, CASE WHEN website_status IN ('VERIFIED_WEBSITE', 'PROBABLE_WEBSITE') THEN 'has_website' WHEN website_status IN ('WEBSITE_UNCERTAIN', 'REQUIRES_MANUAL_CHECK') THEN 'manual_check' WHEN website_status = 'IDENTITY_UNVERIFIED' THEN 'website_identity' WHEN website_status <> 'VERIFIED_NO_WEBSITE' THEN 'not_checked' END, CASE WHEN website_status = 'VERIFIED_NO_WEBSITE' AND coalesce(website_confidence, 0) < 70 THEN 'website_confidence' END, CASE WHEN phone_e164 IS NULL THEN 'no_phone' END], lambda x: x IS NOT NULL)"


@query(f"""{with_views("v_business")}, j AS (SELECT *, {BLOCKERS} AS bl FROM v_business) SELECT id, len(bl) = 0 AS qualifies, array_to_string(bl, ',') AS blockers,
array_to_string(list_filter([CASE WHEN identity_status = 'CONFIRMED' THEN 'identity_confirmed' END, CASE WHEN website_status = 'VERIFIED_NO_WEBSITE' THEN 'no_website' END, CASE WHEN phone_e164 IS NOT NULL THEN 'callable_phone' END], lambda x: x IS NOT NULL), ',') AS reasons,
CASE WHEN len(bl) = 0 THEN 'Qualifies' WHEN bl[1] = 'has_website' THEN 'Has website' WHEN bl[1] = 'manual_check' THEN 'Needs check' WHEN bl[1] = 'no_phone' THEN 'No phone' WHEN bl[1] IN ('identity_status', 'identity_confidence', 'website_identity') THEN 'Identity' WHEN bl[1] = 'excluded' THEN 'Excluded' WHEN bl[1] = 'not_checked' THEN 'Not checked' ELSE 'No' END AS label FROM j""")
def q1_q2_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1 and Q2: blockers, reasons, label."""
    b = view(spark, sf_dir, "v_business").withColumn("q", op.qualify())
    return b.select("id", "q.qualifies", F.array_join("q.blockers", ",").alias("blockers"), F.array_join("q.reasons", ",").alias("reasons"), "q.label")


@query(f"""{with_views("v_business", "v_lead")}, w AS (SELECT id, k % 10 = 3 AS forced, {BLOCKERS} AS bl FROM v_business WHERE k % 5 = 3 AND id NOT IN (SELECT business_id FROM v_lead))
SELECT id, len(bl) = 0 OR forced AS taken, CASE WHEN len(bl) = 0 OR forced THEN len(bl) > 0 END AS overridden, CASE WHEN NOT (len(bl) = 0 OR forced) THEN array_to_string(bl, ',') END AS blockers FROM w""")
def q3_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q3: promote a batch of requests."""
    b = view(spark, sf_dir, "v_business")
    taken, _, refused = op.promote(b, view(spark, sf_dir, "v_lead"), b.where("k % 5 = 3").select("id", (F.col("k") % 10 == 3).alias("forced")), AS_OF)
    return taken.select(F.col("business_id").alias("id"), F.lit(True).alias("taken"), "overridden", F.lit(None).cast("string").alias("blockers")).unionByName(refused.select("id", F.lit(False).alias("taken"), F.lit(None).cast("boolean").alias("overridden"), F.array_join("blockers", ",").alias("blockers")))


@query(f"""{with_views("v_business", "v_lead")} SELECT b.id, CASE WHEN k % 10 = 1 THEN {AS_OF} WHEN k % 10 = 6 THEN NULL ELSE excluded_ms END AS excluded_ms, CASE WHEN k % 10 = 1 THEN 'asked' END AS reason, l.lead_id FROM v_business b LEFT JOIN v_lead l ON l.business_id = b.id AND k % 10 <> 1""")
def q4_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q4: exclude and restore a batch."""
    b = view(spark, sf_dir, "v_business")
    ids = b.where("k % 5 = 1").select("id", F.when(F.col("k") % 10 == 1, "asked").alias("reason"))
    out, left = op.exclude(b, view(spark, sf_dir, "v_lead"), ids, AS_OF)
    return out.join(left.select(F.col("business_id").alias("id"), "lead_id"), "id", "left").select("id", "excluded_ms", F.col("exclusion_reason").alias("reason"), "lead_id")


@query(f"""{with_views("v_call")} SELECT call_id, coalesce(explicit_status, CASE outcome {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in OUTCOME_STATUS.items())} END, CASE WHEN lead_status IN ('new', 'ready_to_call') THEN 'called' ELSE lead_status END) AS new_status FROM v_call""")
def q5_call_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q5: the status that a call sets."""
    return op.status_after_call(view(spark, sf_dir, "v_call")).select("call_id", "new_status")


@query(f"""{with_views("v_verification")}, m AS (SELECT 'm' || verification_id AS verification_id, business_id, finished_ms + 1000000000 AS finished_ms, status, url, 100 AS confidence, true AS by_hand FROM v_verification WHERE confidence % 7 = 0 AND (status <> 'VERIFIED_WEBSITE' OR url IS NOT NULL)),
u AS (SELECT *, false AS by_hand FROM v_verification UNION ALL BY NAME SELECT * FROM m) SELECT business_id, verification_id, status, url, confidence, by_hand FROM u QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY finished_ms DESC, by_hand DESC, verification_id DESC) = 1""")
def q6_manual_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q6: verdicts by hand among computed ones."""
    v = view(spark, sf_dir, "v_verification")
    manual = v.where("confidence % 7 = 0").withColumns({"verification_id": F.concat(F.lit("m"), "verification_id"), "finished_ms": F.col("finished_ms") + 1_000_000_000})
    return op.manual_overlay(v, manual).select("business_id", "verification_id", "status", "url", "confidence", "by_hand")


FILTERS = (
    ("pool", "excluded_ms IS NULL", {}),
    ("leads_no_demo", "lead_id IS NOT NULL AND excluded_ms IS NULL AND NOT is_demo", {"scope": "leads", "include_demo": False}),
    ("search", "(contains(lower(name), 'ring') OR coalesce(contains(lower(city), 'ring'), false) OR coalesce(contains(lower(street), 'ring'), false) OR coalesce(contains(phone_e164, 'ring'), false) OR coalesce(contains(postal_code, 'ring'), false))", {"search": " Ring ", "include_excluded": True}),
    ("unassigned", "excluded_ms IS NULL AND assigned_user_id IS NULL AND lead_status IN ('new', 'called')", {"assigned": "unassigned", "lead_status": ("new", "called")}),
    ("mine", "excluded_ms IS NULL AND assigned_user_id = 'u7' AND category = 'machinery'", {"assigned": "u7", "category": "machinery"}),
    ("qualified", "excluded_ms IS NULL AND website_status = 'VERIFIED_NO_WEBSITE' AND identity_status = 'CONFIRMED' AND phone_e164 IS NOT NULL", {"qualified_only": True}),
    ("manual", "excluded_ms IS NULL AND website_status IN ('REQUIRES_MANUAL_CHECK', 'WEBSITE_UNCERTAIN', 'IDENTITY_UNVERIFIED')", {"needs_manual_check": True}),
    ("uncalled", "excluded_ms IS NULL AND coalesce(call_count, 0) = 0 AND city_key = 'koeln'", {"uncalled": True, "city_key": "koeln"}),
    ("callback_due", f"excluded_ms IS NULL AND next_callback_ms <= {AS_OF}", {"callback_due": True}),
    ("statuses", "excluded_ms IS NULL AND website_status IN ('VERIFIED_WEBSITE') AND identity_status IN ('CONFIRMED', 'PROBABLE')", {"website_status": ("VERIFIED_WEBSITE",), "identity_status": ("CONFIRMED", "PROBABLE")}),
)


@query(f"{VIEW}, z AS (SELECT *, CASE WHEN city IS NOT NULL THEN {q.norm('city')} END AS city_key FROM lv) " + " UNION ALL ".join(f"SELECT '{n}' AS filter, count(*) AS n, coalesce(sum(k), 0)::bigint AS key_sum FROM z WHERE {c}" for n, c, _ in FILTERS))
def f1_f4_a3_list_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under each list filter, counted in one pass."""
    from ..functions.text import normalize_text

    rows = joined(spark, sf_dir).withColumn("city_key", F.when(F.col("city").isNotNull(), normalize_text(F.col("city"))))
    conditions = [(name, op.list_filter(AS_OF, **args)) for name, _, args in FILTERS]
    counted = rows.agg(F.array(*[F.struct(F.lit(name).alias("filter"), F.count_if(c).alias("n"), F.coalesce(F.sum(F.when(c, F.col("k"))), F.lit(0)).alias("key_sum")) for name, c in conditions]).alias("x"))
    return counted.select(F.explode("x").alias("x")).select("x.*")


@query(f"""{with_views("v_business")} SELECT id FROM v_business WHERE checked_ms IS NULL OR {AS_OF} - checked_ms > {30 * DAY}""")
def f8_stale_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: checks that are due again."""
    return op.stale(view(spark, sf_dir, "v_business"), AS_OF).select("id")


@query(f"{VIEW} SELECT id, name, lead_id, lead_status, status_order, user_name, priority, call_count, next_callback_ms FROM lv")
def j1_lead_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Businesses with leads, statuses and users."""
    return joined(spark, sf_dir).select("id", "name", "lead_id", "lead_status", "status_order", "user_name", "priority", "call_count", "next_callback_ms")


@query(f"""{with_views("v_change", "v_user")} SELECT change_id, lead_id, to_status, created_ms, user_name FROM v_change c LEFT JOIN v_user u USING (user_id)""")
def j6_history_with_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows with names."""
    return op.with_users(view(spark, sf_dir, "v_change"), view(spark, sf_dir, "v_user")).select("change_id", "lead_id", "to_status", "created_ms", "user_name")


@query(f"{VIEW} SELECT row_number() OVER (ORDER BY website_confidence DESC NULLS LAST, name_lower, id) AS place, id, website_confidence FROM lv WHERE excluded_ms IS NULL QUALIFY place BETWEEN 51 AND 100")
def o1_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: the second page of fifty, by confidence, nulls last."""
    from pyspark.sql import Window

    page = op.page_of(joined(spark, sf_dir).where(op.list_filter(AS_OF)), "website_confidence", True, 50, 50)
    return page.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("website_confidence"), "name_lower", "id")) + 50).select(F.col("place").cast("long"), "id", "website_confidence")


CALLABLE = f"lead_id IS NOT NULL AND excluded_ms IS NULL AND phone_e164 IS NOT NULL AND is_callable AND (next_callback_ms IS NULL OR next_callback_ms <= {AS_OF})"
ORDER = f"CASE WHEN next_callback_ms <= {AS_OF} THEN 0 ELSE 1 END, CASE WHEN assigned_user_id = {{0}} THEN 0 WHEN assigned_user_id IS NULL THEN 1 ELSE 2 END, priority DESC, call_count, coalesce(last_call_ms, 0), name_lower, id"


@query(f"{VIEW} SELECT id, row_number() OVER (ORDER BY {ORDER.format(chr(39) + 'u7' + chr(39))}) AS place FROM lv WHERE {CALLABLE} QUALIFY place <= 50")
def o2_calling_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: one user's queue."""
    from pyspark.sql import Window

    top = op.calling_queue(joined(spark, sf_dir), "u7", AS_OF)
    own = F.when(F.col("assigned_user_id") == "u7", 0).when(F.col("assigned_user_id").isNull(), 1).otherwise(2)
    due = F.when(F.coalesce(F.col("next_callback_ms") <= AS_OF, F.lit(False)), 0).otherwise(1)
    return top.select("id", F.row_number().over(Window.orderBy(due, own, F.desc("priority"), "call_count", F.coalesce("last_call_ms", F.lit(0)), "name_lower", "id")).cast("long").alias("place"))


@query(f"{VIEW} SELECT u.user_id, id, row_number() OVER (PARTITION BY u.user_id ORDER BY {ORDER.format('u.user_id')}) AS rank FROM lv, v_user u WHERE {CALLABLE} QUALIFY rank <= 50")
def o2_all_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2 for every user at once."""
    return op.all_queues(joined(spark, sf_dir), view(spark, sf_dir, "v_user"), AS_OF).select("user_id", "id", F.col("rank").cast("long"))


@query(f"{with_views('v_change')} SELECT change_id, created_ms FROM v_change ORDER BY created_ms DESC, change_id DESC LIMIT 100")
def o3_newest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the newest rows of an event table."""
    return op.newest(view(spark, sf_dir, "v_change"), 100, "created_ms", "change_id").select("change_id", "created_ms")


@query(f"{with_views('v_user', 'v_lead')}, {STATUSES} SELECT 'status' AS list, key AS name, (SELECT count(*) FROM v_lead WHERE status = key) AS leads, row_number() OVER (ORDER BY sort_order) AS place FROM s UNION ALL SELECT 'user', user_name, NULL, row_number() OVER (ORDER BY lower(user_name), user_id) FROM v_user")
def o4_dimension_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses by order (with their leads) and users by name."""
    from pyspark.sql import Window

    n = view(spark, sf_dir, "v_lead").groupBy(F.col("status").alias("key")).agg(F.count("*").alias("leads"))
    s = op.status_table(spark).join(n, "key", "left").select(F.lit("status").alias("list"), F.col("key").alias("name"), F.coalesce("leads", F.lit(0)).alias("leads"), F.row_number().over(Window.orderBy("sort_order")).cast("long").alias("place"))
    u = view(spark, sf_dir, "v_user").select(F.lit("user").alias("list"), F.col("user_name").alias("name"), F.lit(None).cast("long").alias("leads"), F.row_number().over(Window.orderBy(F.lower("user_name"), "user_id")).cast("long").alias("place"))
    return s.unionByName(u)


@query(f"""{with_views("v_business", "v_lead")}, {STATUSES}, b AS (SELECT count(*) AS researched, count_if(website_status = 'VERIFIED_NO_WEBSITE' AND identity_status = 'CONFIRMED' AND phone_e164 IS NOT NULL)::bigint AS qualified, count_if(website_status IN ('REQUIRES_MANUAL_CHECK', 'WEBSITE_UNCERTAIN', 'IDENTITY_UNVERIFIED'))::bigint AS manual_check FROM v_business WHERE excluded_ms IS NULL),
l AS (SELECT count(*) AS leads, count_if(is_callable)::bigint AS callable, count_if(next_callback_ms IS NOT NULL)::bigint AS callbacks, count_if(status = 'interested')::bigint AS interested, count_if(status = 'converted')::bigint AS converted FROM v_lead LEFT JOIN s ON s.key = status) SELECT * FROM b, l""")
def a1_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1: dashboard counts."""
    return op.funnel(view(spark, sf_dir, "v_business"), view(spark, sf_dir, "v_lead"))


@query(f"""{with_views("v_user", "v_call", "v_lead")} SELECT user_id, user_name, (SELECT count(*) FROM v_call c WHERE c.user_id = u.user_id AND started_ms >= {AS_OF - DAY}) AS calls_24h, (SELECT count(*) FROM v_call c WHERE c.user_id = u.user_id AND started_ms >= {AS_OF - 7 * DAY}) AS calls_7d, (SELECT count(*) FROM v_lead l WHERE l.assigned_user_id = u.user_id) AS assigned FROM v_user u WHERE is_active""")
def a2_team_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: calls and leads of each active user."""
    return op.team_activity(view(spark, sf_dir, "v_user"), view(spark, sf_dir, "v_call"), view(spark, sf_dir, "v_lead"), AS_OF)


@query(f"""{with_views("v_call")} SELECT lead_id, count(*) AS call_count, max(started_ms) AS last_call_ms, arg_max(user_id, (started_ms, call_id)) AS last_call_by, arg_max(callback_ms, (updated_ms, call_id)) FILTER (WHERE callback_ms IS NOT NULL) AS next_callback_ms FROM v_call GROUP BY lead_id""")
def a7_call_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead counters from the call log."""
    return op.fold_calls(view(spark, sf_dir, "v_call"))


@query(f"""{with_views("v_use")}, m AS (SELECT *, strftime(make_timestamp(ts_ms * 1000), '%Y-%m') AS period FROM v_use) SELECT use_id, provider, period, row_number() OVER (PARTITION BY provider, period ORDER BY ts_ms, use_id) AS nth, nth <= 100 AS allowed FROM m""")
def a8_metered_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses against a monthly cap."""
    return op.metered_usage(view(spark, sf_dir, "v_use"), 100).select("use_id", "provider", "period", "nth", "allowed")


@query(f"""{with_views("v_use")} SELECT provider, strftime(make_timestamp(ts_ms * 1000), '%Y-%m') AS period, count(*) AS uses FROM v_use GROUP BY 1, 2""")
def a8_monthly_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses by month."""
    return op.monthly_usage(view(spark, sf_dir, "v_use"))


@query(f"""{with_views("v_use")}, RECURSIVE_INPUT AS (SELECT key, ts_ms, event_id, row_number() OVER (PARTITION BY key ORDER BY ts_ms, event_id) AS rn FROM v_use) SELECT * FROM (WITH RECURSIVE w AS (SELECT key, ts_ms, event_id, rn, ts_ms + 86400000 AS reset, 1 AS n FROM RECURSIVE_INPUT WHERE rn = 1 UNION ALL SELECT i.key, i.ts_ms, i.event_id, i.rn, CASE WHEN i.ts_ms >= w.reset THEN i.ts_ms + 86400000 ELSE w.reset END, CASE WHEN i.ts_ms >= w.reset THEN 1 ELSE w.n + 1 END FROM w JOIN RECURSIVE_INPUT i ON i.key = w.key AND i.rn = w.rn + 1)
SELECT key, ts_ms, event_id, n <= 2 AS allowed, greatest(0, 2 - n)::int AS remaining, CASE WHEN n <= 2 THEN 0 ELSE reset - ts_ms END AS retry_after_ms FROM w)""")
def t2_admissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed windows that open with the data."""
    return op.admissions(view(spark, sf_dir, "v_use"), 2, DAY)


@query(f"""{with_views("v_verification")} SELECT business_id, verification_id, status, finished_ms, row_number() OVER (PARTITION BY business_id ORDER BY finished_ms DESC, verification_id DESC) AS rn FROM v_verification QUALIFY rn <= 20""")
def w1_w2_verification_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest twenty verifications of each business; the first is the current one."""
    return op.latest_per(view(spark, sf_dir, "v_verification"), "business_id", [F.desc("finished_ms"), F.desc("verification_id")], 20).select("business_id", "verification_id", "status", "finished_ms", F.col("rn").cast("long"))


@query(f"""{with_views("v_verification", "v_judged")}, l AS (SELECT * FROM v_verification QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY finished_ms DESC, verification_id DESC) = 1)
SELECT l.business_id, l.verification_id, coalesce(c.n, 0) AS candidates, c.urls FROM l LEFT JOIN (SELECT business_id AS v, count(*) AS n, array_to_string(list(url ORDER BY score DESC, seq), ' ') AS urls FROM v_judged GROUP BY 1) c ON c.v = l.verification_id""")
def w1_latest_with_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each business's latest verification with its candidates by score."""
    latest = op.latest_per(view(spark, sf_dir, "v_verification"), "business_id", [F.desc("finished_ms"), F.desc("verification_id")])
    c = view(spark, sf_dir, "v_judged").groupBy(F.col("business_id").alias("verification_id")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "seq", "url"))).alias("own"))
    return latest.join(c, "verification_id", "left").select("business_id", "verification_id", F.coalesce("n", F.lit(0)).alias("candidates"), F.array_join("own.url", " ").alias("urls"))


@query(f"""{with_views("v_sources")} SELECT business_id, arg_max(raw_json, fetched_ms) AS raw_json, count(DISTINCT provider) AS providers FROM v_sources GROUP BY business_id""")
def w3_a4_latest_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest payload and the number of providers, in one aggregation."""
    return view(spark, sf_dir, "v_sources").groupBy("business_id").agg(F.max_by("raw_json", "fetched_ms").alias("raw_json"), F.countDistinct("provider").alias("providers"))


@query(f"""{with_views("v_change")} SELECT change_id, lead_id, lag(to_status) OVER (PARTITION BY lead_id ORDER BY created_ms, change_id) AS from_status, to_status FROM v_change""")
def w8_status_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions of each lead."""
    return op.status_history(view(spark, sf_dir, "v_change")).select("change_id", "lead_id", "from_status", "to_status")


@query(f"""{with_views("v_sources")}, n AS (SELECT provider, external_id, concat(business_id, '') AS business_id, fetched_ms + 5000000 AS fetched_ms, 'new' AS raw_json, 1 AS nw FROM v_sources WHERE fetched_ms % 3 = 0), u AS (SELECT *, 0 AS nw FROM v_sources UNION ALL SELECT * FROM n) SELECT provider, external_id, business_id, fetched_ms, raw_json FROM u QUALIFY row_number() OVER (PARTITION BY provider, external_id ORDER BY fetched_ms DESC, nw DESC) = 1""")
def k1_upsert_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: upsert by (provider, external_id)."""
    s = view(spark, sf_dir, "v_sources")
    new = s.where("fetched_ms % 3 = 0").withColumns({"fetched_ms": F.col("fetched_ms") + 5_000_000, "raw_json": F.lit("new")})
    return upsert(s, new, ["provider", "external_id"], "fetched_ms").select("provider", "external_id", "business_id", "fetched_ms", "raw_json")


@query(f"""{with_views("v_verification", "v_judged", "v_channel")}, c AS (SELECT business_id AS verification_id, count(*) AS n, max(score) AS best FROM v_judged GROUP BY 1), e AS (SELECT business_id AS verification_id, count(*) AS n FROM v_channel GROUP BY 1)
SELECT verification_id, concat('run', cast(finished_ms % 3 AS string)) AS run, status, coalesce(c.n, 0) AS candidates, c.best, coalesce(e.n, 0) AS statements FROM v_verification LEFT JOIN c USING (verification_id) LEFT JOIN e USING (verification_id)""")
def k2_verification_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: three runs written with their candidates and statements, one of them twice, and read back and joined."""
    path = f"{shared_folder(spark)}/verifications-{uuid.uuid4().hex}"
    v = view(spark, sf_dir, "v_verification").withColumn("run_of", F.concat(F.lit("run"), (F.col("finished_ms") % 3).cast("string")))
    of_run = v.select("verification_id", "run_of")
    tables = v, *(stored(view(spark, sf_dir, name).withColumnRenamed("business_id", "verification_id").join(of_run, "verification_id"), "run_of") for name in ("v_judged", "v_channel"))
    for run in ("run0", "run1", "run2", "run1"):
        write_verifications(*[t.where(F.col("run_of") == run).drop("run_of") for t in tables], path, run)
    t = read_verifications(spark, path)
    c = t["candidates"].groupBy("run", "verification_id").agg(F.count("*").alias("candidates"), F.max("score").alias("best"))
    e = t["evidence"].groupBy("run", "verification_id").agg(F.count("*").alias("statements"))
    rows = t["verifications"].join(c, ["run", "verification_id"], "left").join(e, ["run", "verification_id"], "left")
    return rows.select("verification_id", "run", "status", F.coalesce("candidates", F.lit(0)).alias("candidates"), "best", F.coalesce("statements", F.lit(0)).alias("statements"))


OUTCOME = "CASE k % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'refreshed' WHEN 3 THEN 'needs_review' ELSE 'rejected' END"


@query(f"""{with_views("v_business")}, i AS (SELECT concat('run', cast(k % 4 AS string)) AS run_id, {OUTCOME} AS outcome, k % 5 <> 0 AND k % 5 <> 1 AND k % 3 = 0 AS conflict, checked_ms IS NULL AS failed, len({BLOCKERS}) = 0 AS qualifies FROM v_business)
SELECT run_id, count(*) AS found, count_if(outcome = 'new')::bigint AS n_new, count_if(outcome = 'duplicate')::bigint + count_if(outcome = 'needs_review' AND conflict)::bigint AS n_duplicate, count_if(outcome = 'refreshed')::bigint AS n_refreshed, count_if(outcome = 'needs_review')::bigint + count_if(outcome = 'refreshed' AND conflict)::bigint AS n_needs_review, count_if(outcome = 'rejected')::bigint AS n_excluded,
count_if(NOT failed)::bigint AS verified, count_if(failed)::bigint AS verification_failures, count_if(NOT failed AND qualifies)::bigint AS qualified FROM i GROUP BY run_id""")
def k3_a6_run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome rows of four runs, their verifications, and their counters."""
    b = view(spark, sf_dir, "v_business").withColumn("run_id", F.concat(F.lit("run"), (F.col("k") % 4).cast("string")))
    rows = b.select("run_id", F.col("id").alias("incoming_id"), F.col("id").alias("business_id"), F.expr(OUTCOME).alias("outcome"), F.expr("k % 5 <> 0 AND k % 5 <> 1 AND k % 3 = 0").alias("conflict"))
    checks = b.select("run_id", F.col("checked_ms").isNull().alias("failed"), op.qualify()["qualifies"].alias("qualifies"))
    return op.run_statistics(run_items(rows, F.col("run_id")), checks)


@query(f"""{with_views("v_change", "v_user")} SELECT change_id, lead_id, to_status, created_ms, user_name, row_number() OVER (ORDER BY created_ms DESC, change_id DESC) AS place FROM v_change LEFT JOIN v_user USING (user_id) QUALIFY place <= 200""")
def j6_newest_with_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit page, the newest rows with names."""
    from pyspark.sql import Window

    rows = op.with_users(view(spark, sf_dir, "v_change"), view(spark, sf_dir, "v_user"), n=200)
    return rows.select("change_id", "lead_id", "to_status", "created_ms", "user_name", F.row_number().over(Window.orderBy(F.desc("created_ms"), F.desc("change_id"))).cast("long").alias("place"))


@query(f"""{with_views("v_call", "v_user")} SELECT call_id, lead_id, outcome, started_ms, user_name FROM v_call LEFT JOIN v_user USING (user_id)""")
def j6_calls_with_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with names."""
    return op.with_users(view(spark, sf_dir, "v_call"), view(spark, sf_dir, "v_user")).select("call_id", "lead_id", "outcome", "started_ms", "user_name")


@query(f"""{with_views("v_call", "v_user")} SELECT (SELECT count(*) FROM v_call WHERE started_ms >= {AS_OF - 7 * DAY}) AS calls, (SELECT count(*) FROM v_user WHERE is_active) AS active_users""")
def a3_calls_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: calls of a week and active users."""
    return op.calls_since(view(spark, sf_dir, "v_call"), view(spark, sf_dir, "v_user"), AS_OF - 7 * DAY)
