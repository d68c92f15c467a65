"""Registered queries of the change-log engine and their oracle SQL.

The log is derived from `events`: offset event_id, key user_id, signup inserts, error deletes, all others update.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelog.functions import lsn, payload
from tidelog.operators import assemble, chunks, compare, fold, markers, reconcile, replay, scan
from tidelog.sources.log import bounds

FLAGSHIP = "reconcile_snapshot"
Q: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def queries():
    from tidelog import catalog_jobs

    return Q | catalog_jobs.Q


def oracle_sql():
    from tidelog import catalog_jobs

    return SQL | catalog_jobs.SQL


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def log(spark, sf) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    return read(spark, sf, "events").select(F.col("event_id").alias("offset"), F.col("user_id").alias("k"), op.alias("op"), F.col("value").alias("v"))


LOG = """log AS (SELECT event_id AS "offset", user_id AS k, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op, value AS v FROM events)"""
SNAP = "snap AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer)"
WIN = """win AS (SELECT * FROM (SELECT count(*) AS n FROM events) e, LATERAL (VALUES
  ((-9223372036854775807 - 1)::BIGINT, 49::BIGINT, n // 10, n * 3 // 10), (50, 99, n * 995 // 1000, n * 998 // 1000),
  (100, (SELECT max(c_custkey) FROM customer), n // 20, n * 9 // 10)) t(chunk_min, chunk_max, low, high))"""


def snapshot(spark, sf) -> DataFrame:
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))


def windows(spark, sf) -> DataFrame:
    n = read(spark, sf, "events").count()
    top = read(spark, sf, "customer").agg(F.max("c_custkey").alias("m")).first()["m"]
    return spark.createDataFrame([(chunks.LEAST, 49, n // 10, n * 3 // 10), (50, 99, n * 995 // 1000, n * 998 // 1000), (100, top, n // 20, n * 9 // 10)], "chunk_min bigint, chunk_max bigint, low bigint, high bigint")


RECONCILED = f"""WITH {LOG}, {SNAP}, {WIN},
last AS (SELECT k, arg_max(op, "offset") AS op, arg_max(v, "offset") AS v, max("offset") AS o FROM log GROUP BY k),
base AS (SELECT snap.k, snap.v, win.low FROM snap LEFT JOIN win ON snap.k BETWEEN win.chunk_min AND win.chunk_max)
SELECT coalesce(base.k, last.k) AS k,
  CASE WHEN base.low IS NOT NULL AND (last.o IS NULL OR last.o <= base.low) THEN base.v ELSE last.v END AS v,
  CASE WHEN base.low IS NOT NULL AND (last.o IS NULL OR last.o <= base.low) THEN 'snapshot' ELSE 'log' END AS origin
FROM base FULL OUTER JOIN last ON base.k = last.k
WHERE (base.low IS NOT NULL AND (last.o IS NULL OR last.o <= base.low)) OR (last.k IS NOT NULL AND last.op <> 'delete')"""


@query(RECONCILED)
def reconcile_snapshot(spark, sf):
    return reconcile.reconcile(snapshot(spark, sf), log(spark, sf), windows(spark, sf), "k", ["v"])


@query(RECONCILED)
def reconcile_in_steps(spark, sf):
    return reconcile.reconcile_in_steps(snapshot(spark, sf), log(spark, sf), windows(spark, sf), "k", ["v"])


@query(f"""WITH {LOG}, {SNAP}, {WIN} SELECT DISTINCT snap.k, win.chunk_min FROM snap JOIN win ON snap.k BETWEEN chunk_min AND chunk_max
JOIN log ON log.k = snap.k WHERE log."offset" > low AND log."offset" <= high""")
def window_evict_range(spark, sf):
    rows = chunks.with_chunks(snapshot(spark, sf), "k", windows(spark, sf))
    return reconcile.evicted_keys(rows, log(spark, sf), "k")


@query(f"""WITH {LOG}, {SNAP}, {WIN}, clocks AS (SELECT k, max("offset") AS lsn FROM log GROUP BY k)
SELECT snap.k, snap.v FROM snap JOIN win ON snap.k BETWEEN chunk_min AND chunk_max LEFT JOIN clocks ON clocks.k = snap.k WHERE lsn IS NULL OR lsn <= low""")
def snapshot_merge_clock(spark, sf):
    rows = chunks.with_chunks(snapshot(spark, sf), "k", windows(spark, sf)).where("low IS NOT NULL")
    clocks = log(spark, sf).groupBy("k").agg(F.max("offset").alias("lsn"))
    return reconcile.surviving_candidates(rows, clocks, ["k"]).select("k", "v")


@query("SELECT CAST(coalesce(max(o_orderkey), 0) AS BIGINT) AS upper_bound FROM orders")
def upper_bound(spark, sf):
    return chunks.upper_bound(read(spark, sf, "orders"), "o_orderkey")


@query("SELECT min(k) AS chunk_min, max(k) AS chunk_max FROM (SELECT o_orderkey AS k FROM orders ORDER BY 1 LIMIT 1000)")
def keyset_first(spark, sf):
    return chunks.next_page(read(spark, sf, "orders"), "o_orderkey", None, chunks.GREATEST, 1000)


@query("SELECT min(k) AS chunk_min, max(k) AS chunk_max FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey > 123 ORDER BY 1 LIMIT 1000)")
def keyset_next(spark, sf):
    return chunks.next_page(read(spark, sf, "orders"), "o_orderkey", 123, chunks.GREATEST, 1000)


KEYS = "keys AS (SELECT o_orderkey AS k FROM orders)"
MANIFEST = f"""{KEYS}, p AS (SELECT (row_number() OVER (ORDER BY k) - 1) // 500 AS chunk_id, k FROM keys),
g AS (SELECT chunk_id, max(k) AS last, count(*) AS keys FROM p GROUP BY chunk_id), ub AS (SELECT max(k) AS m FROM keys),
manifest AS (SELECT CAST(chunk_id AS BIGINT) AS chunk_id, coalesce(lag(last) OVER (ORDER BY chunk_id) + 1, (-9223372036854775807 - 1)::BIGINT) AS chunk_min,
  CASE WHEN lead(chunk_id) OVER (ORDER BY chunk_id) IS NULL THEN (SELECT m FROM ub) ELSE last END AS chunk_max, keys FROM g)"""


def order_keys(spark, sf):
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))


def order_manifest(spark, sf):
    rows = order_keys(spark, sf)
    return chunks.manifest(rows, "k", 500, chunks.upper_bound(rows, "k").first()[0])


@query(f"WITH {MANIFEST} SELECT * FROM manifest")
def chunk_manifest(spark, sf):
    return order_manifest(spark, sf)


@query(f"""WITH {MANIFEST}, bad AS (SELECT chunk_min, CASE WHEN chunk_id = 2 THEN chunk_max - 1 WHEN chunk_id = 4 THEN chunk_max + 1 ELSE chunk_max END AS chunk_max FROM manifest),
l AS (SELECT *, lag(chunk_max) OVER (ORDER BY chunk_min) AS before, lead(chunk_min) OVER (ORDER BY chunk_min) AS next FROM bad)
SELECT chunk_min, chunk_max, CASE WHEN before >= chunk_min THEN 'overlap' WHEN before + 1 < chunk_min THEN 'gap' ELSE 'does not end at the bound' END AS fault FROM l, ub
WHERE (before IS NOT NULL AND before + 1 <> chunk_min) OR (next IS NULL AND chunk_max <> m)""")
def manifest_proof(spark, sf):
    m = order_manifest(spark, sf)
    upper = chunks.upper_bound(order_keys(spark, sf), "k").first()[0]
    bad = m.withColumn("chunk_max", F.when(F.col("chunk_id") == 2, F.col("chunk_max") - 1).when(F.col("chunk_id") == 4, F.col("chunk_max") + 1).otherwise(F.col("chunk_max")))
    return chunks.manifest_faults(bad, upper)


@query(f"""WITH {MANIFEST}, c AS (SELECT *, chunk_id % 5 <> 3 AS completed FROM manifest), s AS (SELECT min(CASE WHEN NOT completed THEN chunk_min END) AS stop FROM c)
SELECT CAST(coalesce(max(chunk_max), -9223372036854775807 - 1) AS BIGINT) AS completed_through, count(*) AS chunks FROM c, s WHERE stop IS NULL OR chunk_min < stop""")
def contiguous_frontier(spark, sf):
    return chunks.contiguous_frontier(order_manifest(spark, sf).withColumn("completed", F.col("chunk_id") % 5 != 3))


@query(f"""WITH {MANIFEST}, c AS (SELECT 'job' || (chunk_id % 3) AS job_id, CASE WHEN chunk_id % 3 = 0 OR chunk_id % 2 = 0 THEN 'completed' ELSE 'pending' END AS status FROM manifest)
SELECT job_id, count(*) AS chunks, count_if(status = 'completed')::BIGINT AS completed, 0::BIGINT AS failed, CASE WHEN count_if(status = 'completed') = count(*) THEN 'ready_to_verify' ELSE 'running' END AS state FROM c GROUP BY job_id""")
def chunk_progress(spark, sf):
    c = order_manifest(spark, sf).select(F.concat(F.lit("job"), F.col("chunk_id") % 3).alias("job_id"), F.when((F.col("chunk_id") % 3 == 0) | (F.col("chunk_id") % 2 == 0), "completed").otherwise("pending").alias("status"))
    return chunks.progress(c)


LWW = f"""WITH {LOG} SELECT k, arg_max(op, "offset") AS op, max("offset") AS "offset", arg_max(v, "offset") AS v FROM log GROUP BY k"""


@query(LWW)
def lww_fold_max_by(spark, sf):
    return fold.last_changes(log(spark, sf).select("k", "op", "offset", "v"), ["k"], ["offset"])


@query(LWW)
def lww_fold_row_number(spark, sf):
    return fold.last_changes_ranked(log(spark, sf).select("k", "op", "offset", "v"), ["k"], ["offset"])


CLOCKS = f"""{LOG}, old AS (SELECT k, max("offset") AS lsn, 0::BIGINT AS seq, arg_max(op, "offset") = 'delete' AS deleted FROM log WHERE "offset" < (SELECT count(*) // 2 FROM log) GROUP BY k),
fresh AS (SELECT k, op, v, "offset" - (SELECT count(*) // 4 FROM log) AS lsn, 0::BIGINT AS seq FROM log WHERE "offset" >= (SELECT count(*) // 2 FROM log)),
last AS (SELECT k, arg_max(op, lsn) AS op, arg_max(v, lsn) AS v, max(lsn) AS lsn, 0::BIGINT AS seq FROM fresh GROUP BY k)"""


def half_clocks(spark, sf):
    """Clocks of the first half of the log, and last changes of the second with positions a quarter back, so that some are stale."""
    full = log(spark, sf)
    n = full.count()
    old = fold.last_changes(full.where(F.col("offset") < n // 2), ["k"], ["offset"]).select("k", F.col("offset").alias("lsn"), F.lit(0).cast("bigint").alias("seq"), (F.col("op") == "delete").alias("deleted"))
    fresh = full.where(F.col("offset") >= n // 2).select("k", "op", "v", (F.col("offset") - n // 4).alias("lsn"), F.lit(0).cast("bigint").alias("seq"))
    return old, fold.last_changes(fresh, ["k"], ["lsn", "seq"])


@query(f"""WITH {CLOCKS}, {SNAP}, newer AS (SELECT last.* FROM last LEFT JOIN old USING (k) WHERE old.k IS NULL OR last.lsn >= old.lsn)
SELECT k, v FROM snap WHERE k NOT IN (SELECT k FROM newer) UNION ALL SELECT k, v FROM newer WHERE op <> 'delete'""")
def cdc_merge(spark, sf):
    clocks, last = half_clocks(spark, sf)
    return fold.apply_changes(snapshot(spark, sf), fold.newer_changes(last, clocks, ["k"]), ["k"])


@query(f"""WITH {CLOCKS} SELECT coalesce(old.k, last.k) AS k, CASE WHEN old.k IS NULL OR last.lsn >= old.lsn THEN last.lsn ELSE old.lsn END AS lsn, 0::BIGINT AS seq,
CASE WHEN old.k IS NULL OR last.lsn >= old.lsn THEN last.op = 'delete' ELSE old.deleted END AS deleted FROM old FULL OUTER JOIN last ON old.k = last.k""")
def clock_merge(spark, sf):
    clocks, last = half_clocks(spark, sf)
    return fold.merge_clocks(clocks, last, ["k"])


@query(f"""WITH {LOG}, t AS (SELECT log.*, k % 5 AS stream_id FROM log) SELECT r_name AS target, "offset", k, op FROM t JOIN region ON r_regionkey = stream_id OR r_regionkey + 1 = stream_id WHERE r_regionkey <> 4""")
def routes_fanout(spark, sf):
    r = read(spark, sf, "region")
    routes = r.select(F.col("r_regionkey").cast("bigint").alias("stream_id"), F.col("r_name").alias("target"), (F.col("r_regionkey") != 4).alias("active")).unionByName(
        r.select((F.col("r_regionkey") + 1).cast("bigint").alias("stream_id"), F.col("r_name").alias("target"), (F.col("r_regionkey") != 4).alias("active"))
    )
    changes = log(spark, sf).withColumn("stream_id", F.col("k") % 5)
    return fold.fan_out(changes, routes).select("target", "offset", "k", "op")


@query("""WITH t AS (SELECT event_id // 10 AS lsn, min(event_id) AS first_offset, count(*) AS events FROM events GROUP BY 1),
r AS (SELECT * FROM t UNION ALL SELECT lsn, first_offset + 1000000000, events FROM t WHERE lsn % 3 = 0)
SELECT lsn, min(first_offset) AS first_offset, arg_min(events, first_offset) AS events FROM r WHERE lsn % 11 <> 0 GROUP BY lsn""")
def replay_dedupe(spark, sf):
    t = read(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 10).cast("bigint").alias("lsn")).agg(F.min("event_id").alias("first_offset"), F.count("*").alias("events"))
    again = t.where("lsn % 3 = 0").withColumn("first_offset", F.col("first_offset") + 1_000_000_000)
    return assemble.not_applied(assemble.first_deliveries(t.unionByName(again), ["lsn"], "first_offset"), t.where("lsn % 11 = 0"), ["lsn"])


@query("""WITH t AS (SELECT event_id // 10 AS lsn, min(event_id) AS a, max(event_id) AS b, count(*) AS n FROM events GROUP BY 1),
x AS (SELECT *, a + (lsn % 4) * 5 - 5 AS frontier, CASE WHEN lsn % 7 < 4 THEN CASE WHEN lsn % 7 = 0 THEN 0 WHEN lsn % 7 = 1 THEN n + 1 ELSE n END END AS had FROM t)
SELECT lsn, CASE WHEN had IS NOT NULL AND had <= 0 THEN 'error: resnapshot' WHEN had <> n THEN 'error: content differs'
  WHEN b < frontier THEN CASE WHEN had IS NULL THEN 'error: behind the frontier, not in the ledger' ELSE 'past' END WHEN a > frontier THEN 'error: gap'
  WHEN a < frontier THEN CASE WHEN had IS NULL THEN 'error: frontier inside an unapplied transaction' ELSE 'error: frontier inside a replay' END
  ELSE CASE WHEN had IS NULL THEN 'apply' ELSE 'advance' END END AS action FROM x""")
def replay_classify(spark, sf):
    t = read(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 10).cast("bigint").alias("lsn")).agg(F.min("event_id").alias("first_offset"), F.max("event_id").alias("final_offset"), F.count("*").alias("events"))
    t = t.withColumn("fingerprint", payload.fingerprint([F.col("lsn")]))
    r = F.col("lsn") % 7
    ledger = t.where(r < 4).select("lsn", F.when(r == 0, 0).when(r == 1, F.col("events") + 1).otherwise(F.col("events")).cast("bigint").alias("events"), "fingerprint")
    frontier = F.col("first_offset") + (F.col("lsn") % 4) * 5 - 5
    return replay.classify(t, ledger, frontier, ["lsn"]).select("lsn", "action")


def fragments(spark, sf, broken: bool):
    """Conversations as streams of fragments: turn 0 opens one, and every fourth turn opens another. With `broken`, some are lost."""
    c = read(spark, sf, "conversations")
    last = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = c.withColumn("next", last).select(
        F.col("conv_id").alias("stream"), F.col("turn").alias("offset"), (F.col("turn") % 4).alias("index"),
        (F.col("next").isNull() | (F.col("turn") % 4 == 3)).alias("final"), F.col("conv_id").cast("string").alias("source"), F.lit(1).cast("bigint").alias("events"),
    )
    return rows.where("(stream + offset) % 5 <> 1") if broken else rows


FRAG = """f AS (SELECT conv_id AS stream, turn AS "offset", turn % 4 AS idx, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL OR turn % 4 = 3 AS final FROM conversations)"""


@query(f"""WITH {FRAG} SELECT stream, "offset" // 4 + 1 AS island, CAST(stream AS VARCHAR) AS source, min("offset") AS first_offset, max("offset") AS final_offset, count(*) AS fragments,
count(*) AS events, 'complete' AS state FROM f GROUP BY stream, "offset" // 4""")
def fragment_assembly(spark, sf):
    return assemble.transactions(fragments(spark, sf, False))


@query(f"""WITH {FRAG}, b AS (SELECT *, sum((idx = 0)::INT) OVER (PARTITION BY stream ORDER BY "offset") AS island FROM f WHERE (stream + "offset") % 5 <> 1),
g AS (SELECT stream, island, min("offset") AS first_offset, max("offset") AS final_offset, count(*) AS n, min(idx) AS lo, max(idx) AS hi, count_if(final) AS finals, arg_max(final, "offset") AS ended,
  max(max(island)) OVER (PARTITION BY stream) AS last_island FROM b GROUP BY stream, island)
SELECT stream, CAST(island AS BIGINT) AS island, first_offset, final_offset, n AS fragments,
  CASE WHEN lo <> 0 OR hi <> n - 1 OR final_offset - first_offset <> n - 1 OR finals > 1 THEN 'broken' WHEN finals = 1 AND ended THEN 'complete' WHEN finals = 1 THEN 'broken'
  WHEN island < last_island THEN 'abandoned' ELSE 'open' END AS state FROM g""")
def fragment_gaps(spark, sf):
    return assemble.transactions(fragments(spark, sf, True)).select("stream", "island", "first_offset", "final_offset", "fragments", "state")


def altered(spark, sf):
    """Orders without every 97th, with every 89th price changed, and some keys moved."""
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s"))
    other = o.where("k % 97 <> 5").select(F.when(F.col("k") % 101 == 7, F.col("k") + 1_000_000_000).otherwise(F.col("k")).alias("k"), F.when(F.col("k") % 89 == 1, F.col("p") + 1).otherwise(F.col("p")).alias("p"), F.when(F.col("k") % 83 == 2, F.lit(None)).otherwise(F.col("s")).alias("s"))
    return o, other


ALTERED = """o AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM orders), r AS (SELECT CASE WHEN k % 101 = 7 THEN k + 1000000000 ELSE k END AS k,
CASE WHEN k % 89 = 1 THEN p + 1 ELSE p END AS p, CASE WHEN k % 83 = 2 THEN NULL ELSE s END AS s FROM o WHERE k % 97 <> 5)"""


@query(f"""WITH {ALTERED} SELECT coalesce(o.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'missing' WHEN o.k IS NULL THEN 'extra' ELSE 'different' END AS kind FROM o FULL OUTER JOIN r ON o.k = r.k
WHERE o.k IS NULL OR r.k IS NULL OR o.p IS DISTINCT FROM r.p OR o.s IS DISTINCT FROM r.s""")
def exact_compare(spark, sf):
    return compare.differences(*altered(spark, sf), "k")


@query(f"""WITH {ALTERED}, d AS (SELECT coalesce(o.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'missing' WHEN o.k IS NULL THEN 'extra' ELSE 'different' END AS kind FROM o FULL OUTER JOIN r ON o.k = r.k
WHERE o.k IS NULL OR r.k IS NULL OR o.p IS DISTINCT FROM r.p OR o.s IS DISTINCT FROM r.s) SELECT * FROM d ORDER BY k LIMIT 1""")
def first_difference(spark, sf):
    return compare.first_difference(*altered(spark, sf), "k")


@query(f"""WITH {ALTERED} SELECT *, 'source' AS side FROM (SELECT k, p, s FROM o EXCEPT ALL SELECT k, p, s FROM r) UNION ALL
SELECT *, 'replica' AS side FROM (SELECT k, p, s FROM r EXCEPT ALL SELECT k, p, s FROM o)""")
def multiset_difference(spark, sf):
    return compare.multiset_difference(*altered(spark, sf))


@query(f"""WITH {ALTERED}, x AS (SELECT DISTINCT user_id AS k FROM events WHERE event_id >= (SELECT count(*) // 4 FROM events) AND event_id < (SELECT count(*) // 2 FROM events))
SELECT x.k, (o.k IS NULL AND r.k IS NULL) OR (o.k IS NOT NULL AND r.k IS NOT NULL AND o.p IS NOT DISTINCT FROM r.p AND o.s IS NOT DISTINCT FROM r.s) AS "equal" FROM x LEFT JOIN o USING (k) LEFT JOIN r USING (k)""")
def changed_key_compare(spark, sf):
    n = read(spark, sf, "events").count()
    keys = compare.changed_keys(log(spark, sf), "k", n // 4, n // 2, 1 << 30)
    return compare.compare_keys(keys, *altered(spark, sf), "k")


@query("SELECT DISTINCT user_id AS k FROM events WHERE event_id >= (SELECT count(*) // 3 FROM events) AND event_id < (SELECT count(*) * 2 // 3 FROM events)")
def changed_keys_capped(spark, sf):
    n = read(spark, sf, "events").count()
    return compare.changed_keys(log(spark, sf), "k", n // 3, n * 2 // 3, 1 << 30)


@query("""WITH f AS (SELECT lpad(upper(to_hex(event_id)), 8, '0') AS h, event_id FROM events) SELECT 'A' || '/' || h AS lsn_text, CAST(10 * 4294967296 + event_id AS BIGINT) AS lsn FROM f""")
def lsn_parse(spark, sf):
    text = F.concat(F.lit("A/"), F.lpad(F.hex("event_id"), 8, "0"))
    return read(spark, sf, "events").select(text.alias("lsn_text"), lsn.parse_lsn(text).cast("bigint").alias("lsn"))


@query("SELECT n_nationkey::BIGINT AS id, 'gen:' || n_regionkey || ':attempt:' || (n_nationkey + 1) AS next_attempt, 'gen:' || (n_regionkey + 1) || ':attempt:1' AS next_generation FROM nation")
def attempt_bump(spark, sf):
    attempt = F.format_string("gen:%d:attempt:%d", F.col("n_regionkey"), F.col("n_nationkey"))
    return read(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), lsn.bump_attempt(attempt).alias("next_attempt"), lsn.bump_generation(attempt).alias("next_generation"))


@query("SELECT n_name || ':' || n_regionkey || ':' || n_nationkey AS source_key FROM nation")
def source_key(spark, sf):
    return read(spark, sf, "nation").select(lsn.source_key(F.col("n_name"), F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("source_key"))


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name, n_regionkey::BIGINT AS region, '{\"n_nationkey\":\"' || n_nationkey || '\",\"n_name\":\"' || n_name || '\",\"nothing\":null}' AS payload FROM nation")
def row_payload_json(spark, sf):
    n = read(spark, sf, "nation").withColumn("nothing", F.lit(None).cast("string"))
    body = payload.row_payload(["n_nationkey", "n_name", "nothing"])
    full = payload.row_payload(["n_nationkey", "n_name", "n_regionkey"])
    return n.select(payload.payload_cell(full, "n_nationkey", "bigint").alias("id"), payload.payload_cell(full, "n_name", "string").alias("name"), payload.payload_cell(full, "n_regionkey", "bigint").alias("region"), body.alias("payload"))


@query("SELECT event_id, '{\"a\":[true,null],\"b\":' || (event_id % 7) || '}' AS canonical FROM events")
def canonical_json(spark, sf):
    raw = F.concat(F.lit('{"b": '), (F.col("event_id") % 7).cast("string"), F.lit('.0, "a" : [true, null]}'))
    return read(spark, sf, "events").select("event_id", payload.canonical_json(raw).alias("canonical"))


@query("SELECT event_id, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') AS stamp FROM events")
def timestamp_normalise(spark, sf):
    return read(spark, sf, "events").select("event_id", payload.canonical_timestamp(F.col("ts")).alias("stamp"))


@query("SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS keys, max(event_id) AS last_offset, CAST((SELECT max(event_id) + 1 FROM events) - max(event_id) AS BIGINT) AS lag FROM events GROUP BY event_type")
def metrics_rollup(spark, sf):
    e = read(spark, sf, "events")
    end = e.agg((F.max("event_id") + 1).alias("end_offset"))
    each = e.groupBy("event_type").agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("keys"), F.max("event_id").alias("last_offset"))
    return each.crossJoin(F.broadcast(end)).select("event_type", "events", "keys", "last_offset", fold.lag(F.col("last_offset"), F.col("end_offset")).cast("bigint").alias("lag"))  # one row


@query("""WITH g AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events)
SELECT user_id, event_id, CAST(median(gap) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS DOUBLE) AS median_gap FROM g""")
def sizer_median(spark, sf):
    gaps = read(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))).alias("gap"))
    return gaps.select("user_id", "event_id", scan.running_median(gaps, "gap", ["user_id"], "event_id").alias("median_gap"))


@query("SELECT min(event_id) AS earliest, max(event_id) + 1 AS end_offset, min(CASE WHEN event_type = 'signup' AND event_id >= 500 THEN event_id + 1 END) AS after_barrier FROM events")
def log_offsets(spark, sf):
    barriers = log(spark, sf).select("offset", F.lit("b").alias("id"), F.when(F.col("op") == "insert", "barrier").alias("kind"))
    found = bounds(log(spark, sf).withColumn("partition", F.lit(0))).drop("partitions")
    return found.crossJoin(markers.after_barrier(barriers, "b", 500).withColumnRenamed("next_offset", "after_barrier"))  # one row each


@query(f"""WITH {SNAP}, staged AS (SELECT k, v % 2 < 1 AS evicted FROM snap), fresh AS (SELECT DISTINCT user_id AS k, user_id % 10 = 0 AS evicted FROM events)
SELECT coalesce(staged.k, fresh.k) AS k, fresh.k IS NOT NULL AS refreshed, coalesce(staged.evicted, false) OR coalesce(fresh.evicted, false) AS evicted FROM staged FULL OUTER JOIN fresh ON staged.k = fresh.k""")
def stage_candidates(spark, sf):
    """Every customer is staged; every user of the log is staged again."""
    staged = snapshot(spark, sf).select("k", F.col("v").cast("string").alias("payload"), (F.col("v") % 2 < 1).alias("evicted"))
    fresh = log(spark, sf).select("k").distinct().select("k", F.concat(F.lit("new"), F.col("k")).alias("payload"), (F.col("k") % 10 == 0).alias("evicted"))
    return fold.stage_candidates(staged, fresh, ["k"]).select("k", F.col("payload").startswith("new").alias("refreshed"), "evicted")


@query("SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey IN (SELECT user_id FROM events)")
def key_set_scan(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    return scan.key_rows(rows, "k", log(spark, sf))


@query("SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey BETWEEN (SELECT max(o_orderkey) // 4 FROM orders) AND (SELECT max(o_orderkey) * 3 // 4 FROM orders)")
def range_scan(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"))
    top = chunks.upper_bound(rows, "k").first()[0]
    return scan.range_rows(rows, "k", top // 4, top * 3 // 4)
