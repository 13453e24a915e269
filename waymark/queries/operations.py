"""Queries of counts, queues, matching, merging, publishing and tests (survey 2.3-2.5, 2.7, 2.9-2.11)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import geo, text
from waymark.operators import commits, matching, merging, publishing, quality, queues, stats
from waymark.queries.registry import Tables, query

_NOW = "TIMESTAMP '2024-01-25 00:00:00'"


def _now() -> F.Column:
    return F.lit(dt.datetime(2024, 1, 25))


# Counts.


@query("""
SELECT count(*) AS records, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 50) AS large, count(*) FILTER (WHERE event_type IN ('view', 'click')) AS seen FROM {events}""")
def stats_counts(t: Tables) -> DataFrame:
    """Counts by condition in one pass."""
    return stats.conditional_counts(t.events, [], {"errors": F.col("event_type") == "error", "large": F.col("value") > 50, "seen": F.col("event_type").isin("view", "click")})


@query("""
SELECT l_returnflag, l_linestatus, count(*) AS records, count(*) FILTER (WHERE l_quantity > 25) AS many, count(*) FILTER (WHERE l_discount = 0) AS undiscounted, count(DISTINCT l_suppkey) AS suppliers
FROM {lineitem} GROUP BY l_returnflag, l_linestatus""")
def coverage_funnel(t: Tables) -> DataFrame:
    """Counts by condition and key, and distinct values (A2, A4)."""
    many, undiscounted = F.count_if(F.col("l_quantity") > 25), F.count_if(F.col("l_discount") == 0)
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("records"), many.alias("many"), undiscounted.alias("undiscounted"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("""
SELECT coalesce(o_orderstatus, 'all') AS o_orderstatus, count(*) AS n, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent, round(count(*) FILTER (WHERE o_orderpriority LIKE '1%')::DOUBLE / nullif(count(*), 0), 3) AS urgent_share, count(DISTINCT o_custkey) AS customers
FROM {orders} GROUP BY ROLLUP (o_orderstatus)""")
def scorecard_rollup(t: Tables) -> DataFrame:
    """By status and over all (A3, A4, M7)."""
    urgent = F.count_if(F.startswith("o_orderpriority", F.lit("1")))
    return stats.rolled_up(t.orders, "o_orderstatus", [F.count(F.lit(1)).alias("n"), urgent.alias("urgent"), stats.ratio(urgent, F.count(F.lit(1))).alias("urgent_share"), F.countDistinct("o_custkey").alias("customers")])


@query("""
WITH b AS (SELECT unnest(['urgent', 'high', 'low', 'none']) AS bucket, unnest([0, 1, 2, 3]) AS place),
n AS (SELECT CASE WHEN o_orderpriority LIKE '1-%' THEN 'urgent' WHEN o_orderpriority LIKE '2-%' THEN 'high' WHEN o_orderpriority LIKE '5-%' THEN 'low' ELSE 'other' END AS bucket, count(*) AS n FROM {orders} GROUP BY 1)
SELECT bucket, place, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT sum(n) FROM n), 1)::DOUBLE AS pct FROM b LEFT JOIN n USING (bucket)""")
def status_buckets(t: Tables) -> DataFrame:
    """Fixed buckets with their share, empty ones too."""
    bucket = stats.status_bucket("o_orderpriority", [("1-", "urgent"), ("2-", "high"), ("5-", "low")], "other")
    return stats.filled_buckets(t.orders.select(bucket.alias("bucket")), "bucket", ["urgent", "high", "low", "none"])


@query(f"""
SELECT kind AS stage, max(seen_at) FILTER (WHERE status = 'ok') AS last_success, max(seen_at) FILTER (WHERE artifact_id % 3 > 0) AS last_progress, count(*) FILTER (WHERE seen_at >= {_NOW} - INTERVAL 7 DAYS) AS recent_runs,
  count(*) FILTER (WHERE status = 'error' AND seen_at >= {_NOW} - INTERVAL 7 DAYS) AS recent_errors,
  coalesce(floor(epoch({_NOW}) - epoch(max(seen_at) FILTER (WHERE artifact_id % 3 > 0))) > CASE kind WHEN 'view' THEN 43200 WHEN 'click' THEN 86400 END, true) AS is_stale
FROM {{artifacts}} GROUP BY kind""")
def stage_health(t: Tables) -> DataFrame:
    """By stage, the last success and progress, recent runs and staleness."""
    runs = t.artifacts.select(F.col("kind").alias("stage"), F.col("seen_at").alias("started_at"), "status", (F.col("artifact_id") % 3).alias("rows_ok"))
    return stats.stage_health(runs, _now(), {"view": 43200, "click": 86400}).drop("age_seconds")


@query("SELECT coalesce(event_type, 'none') AS kind, user_id % 3 AS shard, count(*) AS n FROM {events} GROUP BY 1, 2 ORDER BY n DESC, kind, shard")
def counted_by_keys(t: Tables) -> DataFrame:
    """Rows by two keys, most first."""
    return stats.counted_by(t.events, {"kind": F.coalesce("event_type", F.lit("none")), "shard": F.col("user_id") % 3})


@query("""
SELECT g.place_id, g.lat4, g.lon4, d.sharing FROM (SELECT place_id, round(latitude, 4) AS lat4, round(longitude, 4) AS lon4 FROM {places} WHERE latitude IS NOT NULL) g
JOIN (SELECT round(latitude, 4) AS lat4, round(longitude, 4) AS lon4, count(*) AS sharing FROM {places} WHERE latitude IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1) d USING (lat4, lon4)""")
def dense_grid(t: Tables) -> DataFrame:
    """Places that share a point with others (A5, M5)."""
    grid = t.places.where("latitude is not null").select("place_id", geo.cell(F.col("latitude")).alias("lat4"), geo.cell(F.col("longitude")).alias("lon4"))
    return stats.shared_values(grid, ["lat4", "lon4"], 1)


@query("""
SELECT 'everywhere' AS scope, state, count(*) AS places FROM {places} GROUP BY state UNION ALL
SELECT 'even' AS scope, state, count(*) FROM {places} WHERE place_id % 2 = 0 GROUP BY state""")
def overlapping_scopes(t: Tables) -> DataFrame:
    """A row counts in every scope that it belongs to."""
    p = t.places.select("place_id", "state")
    member = p.where("place_id % 2 = 0").select("place_id", F.lit("even").alias("scope"))
    return stats.with_overlapping_scopes(p, member, "place_id", "scope", "everywhere").groupBy("scope", "state").agg(F.count(F.lit(1)).alias("places"))


@query("""
SELECT city, avg(latitude) AS mid_lat, avg(longitude) AS mid_lon, min(latitude) AS south, max(latitude) AS north, min(longitude) AS west, max(longitude) AS east FROM {places} GROUP BY city""")
def group_bounds(t: Tables) -> DataFrame:
    """The middle and the box of each group."""
    return stats.bounds(t.places, "city")


@query("""
WITH r AS (SELECT l_returnflag AS field, l_quantity > 10 AS ok FROM {lineitem}), n AS (SELECT field, count(*) AS n, round(avg(ok::INT), 4) AS precision FROM r GROUP BY field)
SELECT field, precision AS now, 0.95::DOUBLE AS before, round(0.95 - precision, 4) AS drop FROM n WHERE round(0.95 - precision, 4) > CASE WHEN field = 'A' THEN 0.5 ELSE 0.1 END""")
def eval_regressions(t: Tables) -> DataFrame:
    """Fields whose precision fell by more than is allowed."""
    now = stats.field_precision(t.lineitem.select(F.col("l_returnflag").alias("field"), (F.col("l_quantity") > 10).alias("ok")))
    return stats.regressions(now, now.select("field", F.lit(0.95).alias("precision")), 0.1, {"A": 0.5})


# Queues.


@query("SELECT subject_id, kind, arg_max(artifact_id, (seen_at, artifact_id)) AS artifact_id, max(seen_at) AS seen_at FROM {artifacts} GROUP BY subject_id, kind")
def latest_version(t: Tables) -> DataFrame:
    """The newest artifact of each subject and kind."""
    return queues.latest_versions(t.artifacts).select("subject_id", "kind", "artifact_id", "seen_at")


_INPUTS = """
SELECT subject_id, string_agg(artifact_id::VARCHAR, ',' ORDER BY place, artifact_id) AS artifact_ids, string_agg(kind, ',' ORDER BY place, artifact_id) AS kinds
FROM (SELECT *, CASE kind WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS place FROM (SELECT subject_id, kind, arg_max(artifact_id, (seen_at, artifact_id)) AS artifact_id FROM {artifacts} GROUP BY subject_id, kind)) GROUP BY subject_id"""


@query(_INPUTS)
def ordered_array_agg(t: Tables) -> DataFrame:
    """Each subject's newest artifacts in the kinds' order, as parallel lists."""
    out = queues.ordered_inputs(t.artifacts, ["view", "purchase", "signup"])
    return out.select("subject_id", F.array_join(F.transform("artifact_ids", lambda x: x.cast("string")), ",").alias("artifact_ids"), F.array_join("kinds", ",").alias("kinds"))


@query(f"""
WITH i AS ({_INPUTS.strip()}) SELECT subject_id FROM i WHERE subject_id % 3 <> 0 OR subject_id % 9 = 0""")
def due_set_diff(t: Tables) -> DataFrame:
    """Subjects whose recorded inputs or version aren't today's."""
    now = queues.ordered_inputs(t.artifacts, ["view", "purchase", "signup"]).select("subject_id", "artifact_ids")
    recorded = now.where("subject_id % 3 = 0").select("subject_id", F.reverse("artifact_ids").alias("artifact_ids"), F.when(F.col("subject_id") % 9 == 0, "v1").otherwise("v2").alias("version"))
    return queues.due_for_extraction(now, recorded, "v2")


@query(f"""
WITH l AS (SELECT subject_id, max(seen_at) FILTER (WHERE ok) AS last_ok, max(seen_at) AS last_try FROM {{artifacts}} GROUP BY subject_id)
SELECT c_custkey AS subject_id, last_ok, last_try FROM {{customer}} LEFT JOIN l ON c_custkey = l.subject_id
WHERE (last_ok IS NULL OR last_ok < {_NOW} - INTERVAL 2 DAYS) AND (last_try IS NULL OR last_try < {_NOW} - INTERVAL 24 HOURS)
ORDER BY last_try ASC NULLS FIRST, subject_id LIMIT 260""")
def fetch_queue(t: Tables) -> DataFrame:
    """What to fetch next."""
    subjects = t.customer.select(F.col("c_custkey").alias("subject_id"))
    return queues.fetch_queue(subjects, t.artifacts, _now(), 260, 2, 24)


@query("SELECT subject_id, min(seen_at) AS waiting_since, count(*) AS n FROM {artifacts} WHERE status = 'pending' GROUP BY subject_id ORDER BY waiting_since, subject_id LIMIT 50")
def pending_queue(t: Tables) -> DataFrame:
    """Who waits longest."""
    return queues.pending_groups(t.artifacts, 50)


@query("""
WITH a AS (SELECT artifact_id, subject_id, CASE WHEN subject_id % 5 = 0 AND status = 'pending' THEN 'ok' ELSE status END AS status FROM {artifacts}),
chosen AS (SELECT subject_id FROM a GROUP BY subject_id HAVING bool_or(status = 'ok') AND NOT bool_or(status = 'pending') ORDER BY subject_id LIMIT 20)
SELECT artifact_id, subject_id, CASE WHEN status = 'ok' AND subject_id IN (SELECT subject_id FROM chosen) THEN 'pending' ELSE status END AS status FROM a""")
def requeue(t: Tables) -> DataFrame:
    """The first stale subjects are queued again."""
    a = t.artifacts.withColumn("status", F.when((F.col("subject_id") % 5 == 0) & (F.col("status") == "pending"), "ok").otherwise(F.col("status"))).select("artifact_id", "subject_id", "status")
    return queues.requeue(a, a.select("subject_id"), 20)


@query("""
WITH a AS (SELECT subject_id, CASE WHEN subject_id % 5 = 0 AND status = 'pending' THEN 'ok' ELSE status END AS status FROM {artifacts}), f AS (SELECT subject_id, bool_or(status = 'ok') AS o, bool_or(status = 'pending') AS p FROM a GROUP BY subject_id)
SELECT count(*) AS stale, count(*) FILTER (WHERE coalesce(o, false) AND NOT coalesce(p, false)) AS queueable FROM {customer} LEFT JOIN f ON c_custkey = subject_id WHERE c_custkey % 3 <> 1""")
def stale_counts(t: Tables) -> DataFrame:
    """How many are of another version, and how many could be queued again."""
    a = t.artifacts.withColumn("status", F.when((F.col("subject_id") % 5 == 0) & (F.col("status") == "pending"), "ok").otherwise(F.col("status")))
    subjects = t.customer.select(F.col("c_custkey").alias("subject_id"), F.when(F.col("c_custkey") % 3 == 1, "v2").when(F.col("c_custkey") % 3 == 2, "v1").alias("version"))
    return queues.stale_counts(subjects, a, "v2")


@query("""
WITH h AS (SELECT subject_id, max(seen_at) AS anchor FROM {artifacts} WHERE kind = 'view' AND ok GROUP BY subject_id)
SELECT artifact_id, subject_id FROM {artifacts} JOIN h USING (subject_id) WHERE seen_at >= anchor - INTERVAL 1 DAY AND seen_at <= anchor + INTERVAL 1 DAY""")
def crawl_session(t: Tables) -> DataFrame:
    """What was fetched about when a subject's last good page was."""
    return queues.session_of(t.artifacts, "view").select("artifact_id", "subject_id")


@query("""
SELECT subject_id AS run_id, count(*) AS rows_processed, count(*) FILTER (WHERE ok) AS rows_ok, count(*) FILTER (WHERE NOT ok) AS rows_error,
  CASE WHEN count(*) FILTER (WHERE NOT ok) = 0 THEN 'ok' WHEN count(*) FILTER (WHERE ok) = 0 THEN 'error' ELSE 'partial' END AS status FROM {artifacts} GROUP BY subject_id""")
def run_status(t: Tables) -> DataFrame:
    """How each run went."""
    return queues.run_status(t.artifacts.select(F.col("subject_id").alias("run_id"), "ok"))


@query("SELECT place_id, review_count FROM (SELECT place_id, city, (place_id * 7) % 5 AS review_count FROM {places}) ORDER BY review_count DESC, CASE WHEN lower(city) IN ('nation_1', 'nation_2') THEN 0 ELSE 1 END, place_id LIMIT 40")
def enrichment_order(t: Tables) -> DataFrame:
    """Most reviewed, then the cities that come first."""
    return queues.enrichment_order(t.places.withColumn("review_count", (F.col("place_id") * 7) % 5), ["NATION_1", "Nation_2"], 40).select("place_id", "review_count")


@query("""
WITH c AS (SELECT event_id, user_id, event_type, ts FROM {events}),
h AS (SELECT user_id, event_type, ts FROM {events} WHERE event_type IN ('signup', 'purchase')),
l AS (SELECT c.event_id, arg_max(h.event_type, h.ts) AS v, max(h.ts) AS seen_at FROM c JOIN h ON c.user_id = h.user_id AND h.ts <= c.ts WHERE c.event_type IN ('error', 'click') GROUP BY c.event_id)
SELECT event_id, CASE WHEN event_type IN ('error', 'click') AND v = 'signup' AND ts <= seen_at + INTERVAL 3 DAYS THEN 'verified' ELSE CASE event_type WHEN 'signup' THEN 'verified' ELSE event_type END END AS final,
  coalesce(event_type IN ('error', 'click') AND v = 'signup' AND ts <= seen_at + INTERVAL 3 DAYS, false) AS carried_over
FROM c LEFT JOIN l USING (event_id)""")
def carry_over(t: Tables) -> DataFrame:
    """A check that failed for a passing reason keeps the last verdict."""
    named = F.when(F.col("event_type") == "signup", "verified").otherwise(F.col("event_type")).alias("verdict")
    checks = t.events.select("event_id", "user_id", named, F.col("ts").alias("checked_at"))
    history = t.events.where("event_type in ('signup', 'purchase')").select("user_id", named, F.col("ts").alias("checked_at"))
    return merging.carried_over(checks, history, ["user_id"], ["error", "click"], 3).select("event_id", "final", "carried_over")


# Matching and sets.


@query("""
SELECT c_custkey, EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_filled FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey) AND c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 490000)""")
def semi_anti_flags(t: Tables) -> DataFrame:
    """Semi, anti and existence joins."""
    o = t.orders
    c = t.customer.select("c_custkey").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").join(o.where("o_totalprice > 490000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    return matching.with_flag(c, o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "has_filled")


@query("SELECT n_name AS name FROM {nation} UNION SELECT 'NATION_' || CAST(s_suppkey % 40 AS VARCHAR) FROM {supplier}")
def union_distinct(t: Tables) -> DataFrame:
    """The names of two relations, each once."""
    return t.nation.select(F.col("n_name").alias("name")).union(t.supplier.select(F.concat(F.lit("NATION_"), (F.col("s_suppkey") % 40).cast("string")))).distinct()


@query("""
(SELECT 'removed' AS change, k FROM (SELECT s_nationkey AS k FROM {supplier} EXCEPT ALL SELECT c_nationkey FROM {customer})) UNION ALL
(SELECT 'added', k FROM (SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey FROM {supplier}))""")
def multiset_diff(t: Tables) -> DataFrame:
    """Rows that went and came, as often as they did."""
    return matching.multiset_delta(t.supplier.select(F.col("s_nationkey").alias("k")), t.customer.select(F.col("c_nationkey").alias("k")))


@query("""
SELECT s_suppkey, c_custkey, CASE WHEN s_suppkey % 7 = c_custkey % 7 THEN 'first' ELSE 'second' END AS matched_on
FROM {supplier} JOIN {customer} ON s_nationkey = c_nationkey WHERE s_suppkey % 7 = c_custkey % 7 OR s_suppkey % 11 = c_custkey % 11""")
def or_join_dups(t: Tables) -> DataFrame:
    """Rows equal in one key and in either of two others."""
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("k"), (F.col("s_suppkey") % 7).alias("x"), (F.col("s_suppkey") % 11).alias("y"))
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("k"), (F.col("c_custkey") % 7).alias("x"), (F.col("c_custkey") % 11).alias("y"))
    return matching.any_key_join(s, c, "k", [("x", "x", "first"), ("y", "y", "second")]).select("s_suppkey", "c_custkey", "matched_on")


@query("""
WITH p AS (SELECT latitude, longitude FROM {places} WHERE latitude IS NOT NULL AND longitude IS NOT NULL), n AS (SELECT count(*) // 50 AS c FROM p),
a AS (SELECT latitude, row_number() OVER (ORDER BY latitude) AS up, row_number() OVER (ORDER BY latitude DESC) AS down FROM p), o AS (SELECT longitude, row_number() OVER (ORDER BY longitude) AS up, row_number() OVER (ORDER BY longitude DESC) AS down FROM p)
SELECT (SELECT min(latitude) FROM a, n WHERE up > c) AS south, (SELECT max(latitude) FROM a, n WHERE down > c) AS north, (SELECT min(longitude) FROM o, n WHERE up > c) AS west, (SELECT max(longitude) FROM o, n WHERE down > c) AS east""")
def bbox_trim(t: Tables) -> DataFrame:
    """The box without the outermost fiftieth on each side."""
    return matching.trimmed_box(t.places)


@query("""
WITH n AS (SELECT p_partkey, p_brand, list_distinct(string_split(lower(p_name), ' ')) AS w FROM {part})
SELECT a.p_partkey AS a, b.p_partkey AS b FROM n a JOIN n b ON a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE len(list_intersect(a.w, b.w)) > 0 AND (len(list_intersect(a.w, b.w)) >= 0.6 * len(list_distinct(list_concat(a.w, b.w))) OR (len(list_intersect(a.w, b.w)) >= 2 AND (len(list_intersect(a.w, b.w)) = len(a.w) OR len(list_intersect(a.w, b.w)) = len(b.w))))""")
def token_set_match(t: Tables) -> DataFrame:
    """Names of a block with alike words."""
    names = t.part.select(F.col("p_partkey").alias("id"), "p_brand", text.name_tokens(F.col("p_name")).alias("tokens"))
    return matching.token_set_pairs(names, names, "p_brand", ordered=True)


@query()
def fuzzy_dedup(t: Tables) -> DataFrame:
    """Near-equal names within a block, who stays, and merged groups (J11, T23, B10). The score is no SQL function: the tests hold it to brute force."""
    rows = t.places.select("place_id", F.btrim("name").alias("name"), F.lower("city").alias("city"), F.upper("state").alias("state"), F.col("place_id").cast("int").alias("weight")).withColumn("weight", F.when(F.col("weight") % 2 == 0, 3).otherwise(1))
    return matching.merged_names(rows, ["city", "state"], least=94.0)


@query("""
WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1] * 200 AS x, embedding[2] * 200 AS y FROM {embeddings}),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) < 3 AND abs(a.y - b.y) < 3),
r(id, root) AS (SELECT id, id FROM p UNION SELECT e.b, r.root FROM r JOIN e ON r.id = e.a)
SELECT id, min(root) AS "group" FROM r GROUP BY id""")
def grid_components(t: Tables) -> DataFrame:
    """Points chained by nearness."""
    p = t.embeddings.select(F.col("vec_id").alias("id"), (F.col("embedding")[0] * 200).alias("x"), (F.col("embedding")[1] * 200).alias("y"))
    return matching.proximity_groups(p, 3.0)


@query("SELECT place_id FROM {places} EXCEPT SELECT place_id FROM {reviews}")
def settled_pending(t: Tables) -> DataFrame:
    """What no ledger has."""
    return matching.settled_and_pending(t.places.select("place_id"), t.reviews.select("place_id"), ["place_id"])[1]


@query("""
WITH a AS (SELECT o_orderkey, o_orderstatus FROM {orders} WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM {orders} WHERE o_orderkey % 5 <> 0)
SELECT o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change, o_orderkey % 2 = 0 AS explained
FROM a FULL JOIN b USING (o_orderkey) WHERE (a.o_orderkey IS NULL) <> (b.o_orderkey IS NULL) OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def compare_states(t: Tables) -> DataFrame:
    """What changed between two states, and whether it was meant."""
    o = t.orders.select("o_orderkey", "o_orderstatus")
    after = o.where("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 10 == 0, "X").otherwise(F.col("o_orderstatus")))
    return matching.compare_states(o.where("o_orderkey % 3 <> 0"), after, "o_orderkey", ["o_orderstatus"], o.where("o_orderkey % 2 = 0"))


# Merging and publishing.


@query("""
WITH s AS (SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderkey END AS k, o_orderstatus AS a, o_totalprice AS b FROM {orders} WHERE o_orderdate < TIMESTAMP '1998-01-01'),
c AS (SELECT CASE WHEN o_orderkey % 60 = 0 THEN NULL ELSE o_orderkey END AS k, 'N' AS a, o_totalprice + 1 AS b FROM {orders} WHERE o_orderdate >= TIMESTAMP '1997-01-01')
SELECT coalesce(s.k, c.k) AS k, CASE WHEN c.k IS NULL THEN s.a WHEN s.k IS NULL THEN c.a ELSE c.a END AS a, CASE WHEN s.k IS NULL THEN c.b ELSE s.b END AS b FROM (SELECT * FROM s WHERE k IS NOT NULL) s FULL JOIN (SELECT * FROM c WHERE k IS NOT NULL) c ON s.k = c.k
UNION ALL SELECT k, a, b FROM s WHERE k IS NULL UNION ALL SELECT k, a, b FROM c WHERE k IS NULL""")
def merge_upsert(t: Tables) -> DataFrame:
    """Changes by key, one column of two; a null key always adds."""
    key = lambda n: F.when(F.col("o_orderkey") % n != 0, F.col("o_orderkey")).alias("k")
    state = t.orders.where("o_orderdate < timestamp '1998-01-01'").select(key(50), F.col("o_orderstatus").alias("a"), F.col("o_totalprice").alias("b"))
    changes = t.orders.where("o_orderdate >= timestamp '1997-01-01'").select(key(60), F.lit("N").alias("a"), (F.col("o_totalprice") + 1).alias("b"))
    return merging.upsert(state, changes, ["k"], ["a"])


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type AS service, count(*) + CASE WHEN event_type = 'view' THEN 5 ELSE 0 END AS count FROM {events} GROUP BY 1, 2")
def usage_counters(t: Tables) -> DataFrame:
    """Counters by month and service that grow."""
    e = t.events.select(F.date_format("ts", "yyyy-MM").alias("month"), F.col("event_type").alias("service"))
    state = e.where("service = 'view'").distinct().withColumn("count", F.lit(5).cast("long"))
    return merging.add_counts(state, e, ["month", "service"])


@query("""
SELECT id, place_id, program_type FROM (SELECT id, place_id, program_type FROM {programs} WHERE place_id % 3 <> 0 UNION ALL SELECT id + 1000000, place_id, 'new' FROM {programs} WHERE place_id % 3 = 0 AND band = 1)""")
def replace_set(t: Tables) -> DataFrame:
    """Children of parents that were read again are replaced."""
    c = t.programs.select("id", "place_id", "program_type")
    new = t.programs.where("band = 1").select((F.col("id") + 1000000).alias("id"), "place_id", F.lit("new").alias("program_type"))
    outcome = c.select("place_id", F.when(F.col("place_id") % 3 == 0, "ok").otherwise("error").alias("status"))
    return merging.replace_children(c, new, outcome, "place_id")


@query("""
SELECT place_id, CASE WHEN place_id % 4 = 0 THEN 'Fixed' ELSE trim(city) END AS city FROM {places}""")
def guarded_fix(t: Tables) -> DataFrame:
    """A correction holds only where the old value still stands."""
    s = t.places.select("place_id", "city")
    fixes = s.where("place_id % 2 = 0").select("place_id", F.lit("city").alias("column_name"), F.when(F.col("place_id") % 4 == 0, F.col("city")).otherwise("Elsewhere").alias("old_value"), F.lit("Fixed").alias("new_value"))
    return merging.corrected(s, fixes, "place_id", ["city"])


_PLAN = """
SELECT place_id, field, CASE WHEN NOT there THEN 'insert' WHEN trim(coalesce(old_value, '')) = '' THEN 'fill' ELSE 'replace' END AS action, old_value, new_value FROM (
  SELECT place_id, 'phone' AS field, place_id % 10 <> 1 AS there, CASE WHEN place_id % 10 <> 1 THEN phone END AS old_value, CASE WHEN place_id % 8 = 0 THEN '555-010-' || CAST(1000 + place_id % 9000 AS VARCHAR) ELSE '555-999-0000' END AS new_value,
    place_id % 8 = 0 AS same FROM {places}
  UNION ALL SELECT place_id, 'website', place_id % 10 <> 1, CASE WHEN place_id % 10 <> 1 THEN website END, 'https://place' || CAST(place_id AS VARCHAR) || '.org', place_id % 3 = 0 FROM {places} WHERE place_id % 5 <> 0)
WHERE NOT (there AND same)"""


def _desired(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.places
    key = F.col("place_id")
    phone = F.when(key % 8 == 0, F.concat(F.lit("555-010-"), (1000 + key % 9000).cast("string"))).otherwise("555-999-0000")
    site = F.when(key % 5 == 0, F.lit("https://facebook.com/x")).otherwise(F.concat(F.lit("https://place"), key.cast("string"), F.lit(".org")))
    current = t.places.where("place_id % 10 <> 1").select("place_id", "phone", "website")
    return current, p.select("place_id", phone.alias("phone"), site.alias("website"))


@query(_PLAN)
def publish_plan(t: Tables) -> DataFrame:
    """What a publication would fill, replace and insert."""
    return publishing.plan(*_desired(t), "place_id", ["phone", "website"])


@query("SELECT *, (dense_rank() OVER (ORDER BY place_id) - 1) // 50 AS batch FROM (" + _PLAN + ")")
def publish_batches(t: Tables) -> DataFrame:
    """A publication's changes with the batches of 50 places in which they are made."""
    return commits.numbered_batches(publishing.plan(*_desired(t), "place_id", ["phone", "website"]), "place_id").select("place_id", "field", "action", "old_value", "new_value", "batch")


@query("SELECT place_id, phone, website FROM {places} WHERE place_id % 10 <> 1")
def publish_revert(t: Tables) -> DataFrame:
    """A publication that is applied and reverted leaves what was."""
    current, desired = _desired(t)
    changes = publishing.plan(current, desired, "place_id", ["phone", "website"])
    after = publishing.applied(current, changes, "place_id", ["phone", "website"])
    return publishing.reverted(after, changes.withColumn("id", F.xxhash64("place_id", "field")), "place_id", ["phone", "website"])


@query("""
WITH p AS (SELECT place_id, trim(address) AS address, place_id % 3 <> 0 AS verified, place_id % 13 = 0 AND place_id % 26 <> 0 AS again, place_id % 4 = 1 AND latitude IS NOT NULL AS far FROM {places}),
s AS (SELECT address FROM p WHERE address IS NOT NULL GROUP BY address HAVING count(DISTINCT place_id) > 1),
r AS (SELECT place_id, concat_ws(',', CASE WHEN NOT verified THEN 'not_verified' END, CASE WHEN address IN (SELECT address FROM s) THEN 'shared_address' END, CASE WHEN far THEN 'moved_far' END, CASE WHEN again THEN 'was_reverted' END) AS reasons FROM p)
SELECT place_id, CASE WHEN (SELECT count(*) FROM r WHERE reasons = '') > 50 THEN concat_ws(',', nullif(reasons, ''), 'too_many_rows') ELSE reasons END AS reasons, reasons = '' AND (SELECT count(*) FROM r WHERE reasons = '') <= 50 AS auto FROM r""")
def gate_reasons(t: Tables) -> DataFrame:
    """Why a row of a publication needs a person."""
    rows = t.places.select("place_id", F.btrim("address").alias("address"), (F.col("place_id") % 3 != 0).alias("verified"), "latitude", "longitude", F.col("latitude").alias("old_latitude"), (F.col("longitude") + F.when(F.col("place_id") % 4 == 1, 0.01).otherwise(0.0)).alias("old_longitude"))
    log = t.places.where("place_id % 13 = 0").select(F.explode(F.when(F.col("place_id") % 26 == 0, F.array(F.struct(F.lit(2).alias("id"), F.lit("fill").alias("action")), F.struct(F.lit(1).alias("id"), F.lit("revert").alias("action")))).otherwise(F.array(F.struct(F.lit(1).alias("id"), F.lit("fill").alias("action")), F.struct(F.lit(2).alias("id"), F.lit("revert").alias("action"))))).alias("x"), "place_id").select("place_id", "x.*")
    return publishing.gate(rows, "place_id", publishing.reverted_since(log, "place_id"), most_rows=50)


# Tests of tables.


@query("SELECT 'duplicate' AS problem, count(*) AS n FROM (SELECT o_custkey FROM {orders} GROUP BY o_custkey HAVING count(*) > 1) UNION ALL SELECT 'null', count(*) FROM {places} WHERE latitude IS NULL UNION ALL SELECT 'unexpected', count(*) FROM {orders} WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'orphan', count(*) FROM {lineitem} WHERE l_orderkey NOT IN (SELECT o_orderkey FROM {orders} WHERE o_orderkey % 100 <> 0)")
def quality_violations(t: Tables) -> DataFrame:
    """Rows that break the four generic tests, counted (Q1, Q2)."""
    named = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("problem"), "n")
    bad = quality.unexpected(t.orders, "o_orderstatus", ["O", "F"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("unexpected").alias("problem"), "n")
    lost = quality.orphans(t.lineitem, "l_orderkey", t.orders.where("o_orderkey % 100 <> 0"), "o_orderkey")
    return named("duplicate", quality.not_unique(t.orders, "o_custkey")).unionByName(named("null", quality.null_rows(t.places, "latitude"))).unionByName(bad).unionByName(named("orphan", lost))


@query("""
SELECT 'ERROR' AS level, place_id::VARCHAR AS place, 'no coordinates' AS message FROM {places} WHERE latitude IS NULL UNION ALL SELECT 'WARN', place_id::VARCHAR, 'blank address' FROM {places} WHERE trim(address) = '' UNION ALL SELECT 'WARN', place_id::VARCHAR, 'no house number' FROM {places} WHERE trim(address) <> '' AND NOT regexp_matches(address, '^[0-9]')""")
def validator_findings(t: Tables) -> DataFrame:
    """A row for each rule that a row breaks (Q4)."""
    filled = F.btrim("address") != ""
    return quality.findings(t.places, F.col("place_id"), [("ERROR", F.col("latitude").isNull(), "no coordinates"), ("WARN", F.btrim("address") == "", "blank address"), ("WARN", filled & ~F.rlike("address", F.lit("^[0-9]")), "no house number")])


@query("""
WITH g AS (SELECT place_id, latitude, longitude, lower(trim(address)) AS a, CASE place_id % 5 WHEN 0 THEN 'No_Match' WHEN 1 THEN 'Tie' ELSE 'Match' END AS match, CASE WHEN place_id % 2 = 0 THEN 'Exact' ELSE 'Non_Exact' END AS kind, place_id % 7 <> 3 AS same FROM {places} WHERE latitude IS NOT NULL),
s AS (SELECT latitude, longitude FROM g WHERE match = 'Match' GROUP BY 1, 2 HAVING count(DISTINCT a) > 1)
SELECT g.place_id AS geo_id, CASE WHEN match = 'No_Match' THEN 'failed' WHEN match = 'Tie' THEN 'needs_review' WHEN NOT (g.latitude BETWEEN -15 AND 72 AND (g.longitude BETWEEN -180 AND -64 OR g.longitude BETWEEN 144 AND 180)) THEN 'failed'
  WHEN s.latitude IS NOT NULL THEN 'needs_review' WHEN NOT same THEN 'needs_review' WHEN kind = 'Exact' THEN 'ok' ELSE 'needs_review' END AS status
FROM g LEFT JOIN s USING (latitude, longitude)""")
def geocode_classes(t: Tables) -> DataFrame:
    """What a geocoder's answers are good for."""
    k = F.col("place_id")
    rows = t.places.where("latitude is not null").select(k.alias("geo_id"), F.when(k % 5 == 0, "No_Match").when(k % 5 == 1, "Tie").otherwise("Match").alias("match"), F.when(k % 2 == 0, "Exact").otherwise("Non_Exact").alias("match_type"), "latitude", "longitude", "address", (k % 7 != 3).alias("same_house"))
    return quality.classified_geocodes(rows).select("geo_id", "status")


@query("SELECT c_custkey AS k, CASE WHEN count(o_custkey) = 0 THEN 'missing' ELSE 'repeated' END AS problem FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey GROUP BY 1 HAVING count(o_custkey) <> 1")
def returned_once(t: Tables) -> DataFrame:
    """What didn't come back exactly once (Q15)."""
    return quality.returned_once(t.customer.select(F.col("c_custkey").alias("k")), t.orders.select(F.col("o_custkey").alias("k")), "k")


@query("""
WITH n AS (SELECT (SELECT count(*) FROM {orders}) AS now, (SELECT count(*) FROM {orders} WHERE o_orderkey % 4 <> 0) AS then_rows, (SELECT count(*) FROM {orders} WHERE o_orderkey % 10 <> 0) AS most)
SELECT s, problem FROM (SELECT 'grown' AS s, unnest(CASE WHEN now < 0.8 * most THEN ['too_few_rows'] ELSE [] END) AS problem FROM n
  UNION ALL SELECT 'shrunk', unnest(CASE WHEN then_rows < 0.8 * now THEN ['older', 'too_few_rows'] ELSE ['older'] END) FROM n UNION ALL SELECT 'other_scope', unnest(CASE WHEN most < 0.8 * now THEN ['scope_changed', 'too_few_rows'] ELSE ['scope_changed'] END) FROM n)""")
def snapshot_gate(t: Tables) -> DataFrame:
    """Why a snapshot is refused against the one before: its scope, its time, its number of rows."""

    def snapshot(rows: DataFrame, scope: str, day: int) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(scope).alias("scope"), F.lit(day).alias("taken_at"), "rows")

    whole = snapshot(t.orders, "all", 2)
    pairs = {"grown": (snapshot(t.orders.where("o_orderkey % 10 <> 0"), "all", 1), whole), "shrunk": (whole, snapshot(t.orders.where("o_orderkey % 4 <> 0"), "all", 2)), "other_scope": (whole, snapshot(t.orders.where("o_orderkey % 10 <> 0"), "some", 3))}
    found = [quality.snapshot_problems(a, b).select(F.lit(name).alias("s"), "problem") for name, (a, b) in pairs.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("SELECT count(*) AS rows, true AS same, count(*) = count(DISTINCT o_orderkey) AS unique_keys FROM {orders}")
def snapshot_guard(t: Tables) -> DataFrame:
    """A snapshot's size, whether its digest is that of the same rows in two parts, and whether its keys are unique (S3)."""
    parts = t.orders.where("o_orderkey % 2 = 1").unionByName(t.orders.where("o_orderkey % 2 = 0"))
    a, b = quality.table_digest(t.orders), quality.table_digest(parts)
    unique = quality.not_unique(t.orders, "o_orderkey").agg((F.count(F.lit(1)) == 0).alias("unique_keys"))
    return a.crossJoin(b.select(F.col("digest").alias("other"))).select("rows", (F.col("digest") == F.col("other")).alias("same")).crossJoin(unique)
