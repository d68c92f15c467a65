"""Registered queries of markers, windows, scans, the wire form, the log and backfill jobs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tidelog.catalog import LOG, SNAP, log, read, snapshot
from tidelog.functions import payload
from tidelog.operators import chunks, compare, fold, markers, reconcile, scan
from tidelog.plans import backfill, run
from tidelog.plans.apply import apply_batch
from tidelog.sources import codec, staging
from tidelog.sources.contract import Column, TableContract
from tidelog.sources.log import Log, bounds
from tidelog.sources.shared import shared_folder
from tidelog.sources.state import StateStore

Q: dict = {}
SQL: dict = {}
ACCOUNTS = TableContract("accounts", (Column("k", "int8", False), Column("v", "float8")), "k")
PER_TRANSACTION = 10


def query(sql: str):
    def add(f):
        Q[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


# Markers and windows. Of every hundred events two are markers of one of two jobs; one chunk has no HIGH, some markers are delivered twice.

MARKS = """m AS (SELECT event_id AS "offset", CASE event_id % 100 WHEN 7 THEN 'low' WHEN 57 THEN 'high' ELSE 'barrier' END AS kind, 'job' || (event_id // 100 % 2) AS job_id,
  'gen:1:attempt:' || (event_id // 100 % 3 + 1) AS attempt, CASE WHEN event_id % 100 = 90 THEN 0 ELSE event_id // 100 * 1000 END AS chunk_min, CASE WHEN event_id % 100 = 90 THEN 0 ELSE event_id // 100 * 1000 + 999 END AS chunk_max
  FROM events WHERE event_id % 100 IN (7, 57, 90) AND NOT (event_id % 100 = 57 AND event_id // 100 % 5 = 4)),
ids AS (SELECT *, job_id || ':' || attempt || ':' || kind || ':' || chunk_min || ':' || chunk_max || ':' || "offset" AS id FROM m)"""


def marker_log(spark, sf) -> DataFrame:
    e = read(spark, sf, "events").withColumn("n", F.floor(F.col("event_id") / 100).cast("bigint")).withColumn("r", F.col("event_id") % 100)
    wanted = e.where("r IN (7, 57, 90) AND NOT (r = 57 AND n % 5 = 4)").select(
        F.when(F.col("r") == 7, "low").when(F.col("r") == 57, "high").otherwise("barrier").alias("kind"), F.concat(F.lit("job"), F.col("n") % 2).alias("job_id"),
        F.format_string("gen:1:attempt:%d", F.col("n") % 3 + 1).alias("attempt"), (F.col("n") * 1000).alias("chunk_min"), (F.col("n") * 1000 + 999).alias("chunk_max"), F.col("event_id").alias("nanos"),
    )
    first = markers.written(wanted).withColumn("offset", F.split_part("id", F.lit(":"), F.lit(-1)).cast("bigint")).withColumn("lsn", F.col("offset").cast("decimal(20,0)"))
    return first.unionByName(first.where("chunk_min % 3000 = 0").withColumn("offset", F.col("offset") + 1_000_000_000))


@query(f"WITH {MARKS} SELECT id, kind, job_id, attempt, chunk_min, chunk_max FROM ids")
def marker_ids(spark, sf):
    return markers.once(marker_log(spark, sf)).select("id", "kind", "job_id", "attempt", "chunk_min", "chunk_max")


@query(f"""WITH {MARKS}, c AS (SELECT DISTINCT 'job0' AS job_id, 'gen:1:attempt:' || (event_id // 100 % 3 + 1) AS attempt, event_id // 100 * 1000 AS chunk_min, event_id // 100 * 1000 + 999 AS chunk_max FROM events)
SELECT c.chunk_min, c.chunk_max, coalesce(l."offset", -1) AS low, coalesce(h."offset", -1) AS high, CASE WHEN l."offset" IS NULL THEN 'outside' WHEN h."offset" IS NULL THEN 'inside' ELSE 'completing' END AS state
FROM c LEFT JOIN ids l ON l.kind = 'low' AND l.job_id = c.job_id AND l.chunk_min = c.chunk_min LEFT JOIN ids h ON h.kind = 'high' AND h.job_id = c.job_id AND h.chunk_min = c.chunk_min""")
def marker_windows(spark, sf):
    numbers = read(spark, sf, "events").select(F.floor(F.col("event_id") / 100).cast("bigint").alias("n")).distinct()
    manifest = numbers.select(F.lit("job0").alias("job_id"), F.format_string("gen:1:attempt:%d", F.col("n") % 3 + 1).alias("attempt"), (F.col("n") * 1000).alias("chunk_min"), (F.col("n") * 1000 + 999).alias("chunk_max"))
    found = markers.checked(markers.windows(manifest, marker_log(spark, sf)))
    return found.select("chunk_min", "chunk_max", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("low", "high")], "state")


@query(f"""WITH {MARKS} SELECT CASE WHEN bool_or(id LIKE '%:barrier:%') THEN min("offset") + 1 END AS next_offset FROM ids WHERE kind = 'barrier' AND "offset" >= 200 AND "offset" < 300""")
def barrier_wait(spark, sf):
    found = marker_log(spark, sf)
    name = found.where("kind = 'barrier' AND offset >= 200").agg(F.min_by("id", "offset")).first()[0]
    return markers.after_barrier(found, name or "none", 200)


# Scans

ORDER_ROWS = TableContract("orders", (Column("o_orderkey", "int8", False), Column("o_orderstatus", "text"), Column("o_orderdate", "timestamp"), Column("o_orderpriority", "text")), "o_orderkey")


def order_rows(spark, sf) -> DataFrame:
    return read(spark, sf, "orders").select(*[c.name for c in ORDER_ROWS.columns])


STAMP = "regexp_replace(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '')"


@query(f"SELECT o_orderkey, o_orderstatus, {STAMP} AS o_orderdate, o_orderpriority FROM orders WHERE o_orderkey <= (SELECT max(o_orderkey) // 2 FROM orders)")
def canonical_scan(spark, sf):
    rows = order_rows(spark, sf)
    upper = chunks.upper_bound(rows, "o_orderkey").first()[0]
    return scan.canonical_rows(scan.range_rows(rows, "o_orderkey", chunks.LEAST, upper // 2), ORDER_ROWS)


@query("SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def typed_round_trip(spark, sf):
    return scan.typed_rows(scan.canonical_rows(order_rows(spark, sf), ORDER_ROWS), ORDER_ROWS)


MANY = "p AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS t, (row_number() OVER (ORDER BY o_orderkey) - 1) // 100 AS c FROM orders)"


def many_chunks(spark, sf, size: int = 100) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_totalprice").alias("t"))
    return rows, chunks.manifest(rows, "k", size, chunks.upper_bound(rows, "k").first()[0])


@query(f"WITH {MANY} SELECT c AS chunk_id, count(*) AS rows, CAST(sum(96 + strlen(s)) AS BIGINT) AS bytes FROM p GROUP BY c")
def chunk_sizes(spark, sf):
    rows, manifest = many_chunks(spark, sf)
    return scan.chunk_sizes(chunks.with_chunks(rows, "k", manifest), ["s"], ["chunk_id"])


@query(f"""WITH {MANY}, d AS (SELECT c, k, k % 89 = 1 OR k % 97 = 5 AS bad FROM p) SELECT c AS chunk_id, CAST(count_if(bad) AS BIGINT) AS differences FROM d GROUP BY c""")
def range_compare(spark, sf):
    rows, manifest = many_chunks(spark, sf)
    other = rows.where("k % 97 <> 5").withColumn("t", F.when(F.col("k") % 89 == 1, F.col("t") + 1).otherwise(F.col("t")))
    return compare.range_differences(rows, other, "k", manifest).join(manifest.select("chunk_id", "chunk_min"), "chunk_min").select("chunk_id", "differences")


@query("SELECT range AS chunk_id, range * 500 + 1 AS chunk_min, least(range * 500 + 500, m) AS chunk_max FROM (SELECT max(o_orderkey) AS m FROM orders) t, LATERAL (SELECT unnest(range((m + 499) // 500)) AS range) r")
def arithmetic_pages(spark, sf):
    return chunks.arithmetic_pages(spark, 0, 500, chunks.upper_bound(read(spark, sf, "orders"), "o_orderkey").first()[0])


@query("""WITH g AS (SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM events),
m AS (SELECT user_id, event_id, median(gap) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS d FROM g)
SELECT user_id, event_id, CASE WHEN d > 0 THEN greatest(least(CAST(floor(1000 * least(greatest(100.0::DOUBLE / d, 0.5), 2.0)) AS BIGINT), 1800), 600) ELSE 1000 END AS next_size FROM m""")
def sizer_step(spark, sf):
    gaps = read(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") - F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id"))).alias("gap"))
    found = gaps.select("user_id", "event_id", scan.running_median(gaps, "gap", ["user_id"], "event_id").alias("d"))
    return found.select("user_id", "event_id", scan.next_size(F.lit(1000), F.col("d"), 100.0, 600, 1800).alias("next_size"))


# The wire form and the log

def wire_source():
    return F.struct(F.lit("1").alias("Generation"), F.lit("sys").alias("SystemID"), F.col("tx").alias("XID"), F.concat(F.lit("0/"), F.hex("tx")).alias("LSN"))


def wire_change():
    """A row (tx, op, k, v) as a change on the wire."""
    cells = F.array(
        F.struct(F.lit(1).alias("Kind"), F.col("k").alias("Int"), F.lit("").alias("Text")), F.struct(F.lit(2).alias("Kind"), F.lit(0).cast("bigint").alias("Int"), F.col("v").cast("string").alias("Text")),
    )
    marker = F.lit(None).cast("struct<ID:string,Kind:string,JobID:string,Attempt:string,ChunkMin:bigint,ChunkMax:bigint>")
    return F.struct(F.col("op").alias("Op"), F.lit("e").alias("SchemaID"), F.struct(cells.alias("Values")).alias("Row"), marker.alias("Marker"), wire_source().alias("Source"))


def wire_records(spark, sf, limit: int = 900, below: int | None = None) -> DataFrame:
    """Events as transactions of `PER_TRANSACTION`, in fragments of at most `limit` bytes of changes: (tx, fragment, key, value). `below`: only transactions before it.

    Plain rows are numbered; the wire form, several times as wide, is built after that.
    """
    e = log(spark, sf) if below is None else log(spark, sf).where(F.col("offset") < below * PER_TRANSACTION)
    rows = e.select(F.floor(F.col("offset") / PER_TRANSACTION).cast("bigint").alias("tx"), (F.col("offset") % PER_TRANSACTION).alias("seq"), "op", "k", "v")
    sized = rows.withColumn("bytes", F.octet_length(F.to_json(wire_change(), {"ignoreNullFields": "false"})))
    placed = codec.fragment_numbers(sized, ["tx"], "seq", "bytes", limit)
    return codec.encode(placed.select("tx", "fragment", "seq", wire_change().alias("change"), wire_source().alias("source"), F.lit("e").alias("schema_id")), ["tx"])


def wire_log(spark, sf, extra: int = 0) -> Log:
    """The log with all fragments; the first `extra` transactions are delivered once more at its end."""
    found = Log(spark, shared_folder(spark, "log")).create("changes", "sys")
    found.append(wire_records(spark, sf), ["tx", "fragment"])
    if extra:
        found.append(wire_records(spark, sf, below=extra), ["tx", "fragment"])
    return found


@query("""WITH n AS (SELECT count(*) AS n FROM events), t AS (SELECT event_id // 10 AS tx, count(*) AS changes FROM events GROUP BY 1) SELECT tx, changes FROM t""")
def fragment_round_trip(spark, sf):
    records = wire_records(spark, sf).withColumn("offset", F.monotonically_increasing_id())
    rows = codec.changes(codec.checked(codec.decode(records.select("offset", "value"))))
    return rows.groupBy(F.col("change.Source.XID").alias("tx")).agg(F.count("*").alias("changes"))


@query("SELECT DISTINCT event_id // 10 AS tx, true AS fits, true AS exact FROM events")
def envelope_sizes(spark, sf):
    records = wire_records(spark, sf)
    rows = codec.once(records.select("tx", "value"), e=F.from_json("value", codec.ENVELOPE)).select("tx", F.octet_length("value").alias("size"), "e")
    encoded = F.aggregate(F.transform(F.col("e")["Changes"], lambda c: F.octet_length(F.to_json(c, {"ignoreNullFields": "false"}))), F.lit(0), lambda a, b: a + b)
    computed = codec.envelope_bytes(F.col("e")["Source"], F.col("e")["SchemaID"], F.col("e")["FragmentIndex"], F.col("e")["Final"], F.col("e")["Count"], F.col("e")["TotalCount"], encoded)
    each = rows.select("tx", (encoded <= 900).alias("fits"), (computed == F.col("size")).alias("exact"))
    return each.groupBy("tx").agg(F.bool_and("fits").alias("fits"), F.bool_and("exact").alias("exact"))


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unknown version' WHEN 2 THEN 'count differs' WHEN 3 THEN 'mixed schemas' WHEN 4 THEN 'missing identity' ELSE 'not exactly one payload' END AS fault FROM events""")
def envelope_faults(spark, sf):
    kind = F.col("event_id") % 6
    source = F.lit('{"Generation":"1","SystemID":"s","XID":1,"LSN":"0/1"}')
    row = F.when(kind == 5, F.lit("null")).otherwise(F.lit('{"Values":[]}'))
    change = F.concat(F.lit('{"Op":"insert","SchemaID":"'), F.when(kind == 3, "x").otherwise("e"), F.lit('","Row":'), row, F.lit(',"Marker":null,"Source":'), source, F.lit("}"))
    value = F.concat(
        F.lit('{"Version":'), F.when(kind == 1, "7").otherwise("2"), F.lit(',"SchemaID":"'), F.when(kind == 4, "").otherwise("e"), F.lit('","FragmentIndex":0,"Final":true,"Count":'), F.when(kind == 2, "2").otherwise("1"),
        F.lit(',"TotalCount":2,"Source":'), source, F.lit(',"Changes":['), change, F.lit("]}"),
    )
    found = codec.decode(read(spark, sf, "events").select(F.col("event_id").alias("offset"), value.alias("value")))
    return found.select(F.col("offset").alias("event_id"), "fault")


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN event_type ELSE 'old' || user_id END AS cell, CASE WHEN event_id % 3 = 2 THEN 'old' || user_id ELSE CASE event_id % 3 WHEN 1 THEN event_type END END AS filled FROM events""")
def tuple_decode(spark, sf):
    e = read(spark, sf, "events")
    old, r = F.concat(F.lit("old"), F.col("user_id")), F.col("event_id") % 3
    kind = F.when(r == 0, "n").when(r == 1, "t").otherwise("u")
    new = F.when(r == 1, F.col("event_type"))
    return e.select("event_id", codec.tuple_cell(kind, F.col("event_type"), old).alias("cell"), codec.same_key(codec.filled_update(new, old, r == 2), codec.filled_update(new, old, r == 2)).alias("filled"))


@query("""SELECT event_id AS "offset", 'sys:1:0/' || upper(to_hex(event_id // 10)) AS key FROM events WHERE event_id % 10 = 0 AND event_id // 10 BETWEEN 5 AND 14""")
def log_poll(spark, sf):
    found = Log(spark, shared_folder(spark, "log")).create("changes", "sys")
    found.append(wire_records(spark, sf, codec.FRAGMENT_BYTES), ["tx"])
    found.require_identity("changes", "sys")
    return found.poll(5, 10).select((F.col("offset") * 10).alias("offset"), "key")


@query("SELECT min(event_id) AS earliest, max(event_id) + 1 AS end_offset, 1::BIGINT AS partitions FROM events")
def log_bounds(spark, sf):
    return bounds(log(spark, sf).withColumn("partition", F.lit(0)))


@query("""WITH e AS (SELECT event_id // 10 AS lsn, event_id % 10 AS seq, sha256(strlen(event_type) || ':' || event_type || strlen(CAST(user_id AS VARCHAR)) || ':' || user_id) AS mark FROM events)
SELECT lsn, sha256(string_agg(mark, '' ORDER BY seq)) AS fingerprint, count(*) AS events FROM e GROUP BY lsn""")
def transaction_fingerprint(spark, sf):
    e = read(spark, sf, "events").select(F.floor(F.col("event_id") / 10).cast("bigint").alias("lsn"), (F.col("event_id") % 10).alias("seq"), "event_type", "user_id")
    return payload.transaction_fingerprints(e, ["lsn"], ["event_type", "user_id"], "seq")


@query("""SELECT event_id // 10 AS tx, event_id % 10 AS seq, event_type AS op FROM events WHERE event_type <> 'view'""")
def staged_sequence(spark, sf):
    e = read(spark, sf, "events").select(F.floor(F.col("event_id") / 10).cast("bigint").alias("tx"), "event_id", "event_type")
    t = e.groupBy("tx").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]).alias("changes"))
    # What is a marker takes a number of the sequence, but no row.
    return fold.numbered_changes(t).where("change <> 'view'").select("tx", F.col("seq").cast("bigint").alias("seq"), F.col("change").alias("op"))


@query(f"WITH {SNAP} SELECT k, v FROM snap")
def snapshot_staging(spark, sf):
    path, n = staging.stage(snapshot(spark, sf), ACCOUNTS, shared_folder(spark, "stage"), "live", "job", "gen:1:attempt:1", chunks.LEAST, files=4)
    return staging.staged_rows(staging.load_lines(spark, path), ACCOUNTS, n)


@query(f"WITH {SNAP} SELECT k, v FROM snap WHERE k NOT IN (SELECT user_id FROM events)")
def staged_survivors(spark, sf):
    touched = log(spark, sf).select(F.col("k").alias("__k")).distinct()
    rows = snapshot(spark, sf).withColumn("payload", F.concat(F.lit("["), payload.row_payload(["k", "v"]), F.lit("]")))
    candidates = rows.join(touched, F.col("k") == F.col("__k"), "left").select("payload", F.col("__k").isNotNull().alias("evicted"))
    return staging.surviving_rows(candidates, ACCOUNTS)


@query("""SELECT event_id, CAST(event_id AS BIGINT) AS i, event_id % 2 = 0 AS b, event_type AS s, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, ts AS t FROM events""")
def payload_cells(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.col("event_id").alias("i"), F.when(F.col("event_id") % 2 == 0, "t").otherwise("f").alias("b"), F.col("event_type").alias("s"), F.col("ts").cast("date").alias("d"), F.col("ts").alias("t"))
    body = e.select("event_id", payload.row_payload(["i", "b", "s", "d", "t"]).alias("p"))
    kinds = TableContract("x", (Column("i", "int8", False), Column("b", "bool"), Column("s", "text"), Column("d", "date"), Column("t", "timestamp")), "i")
    found = body.select("event_id", *[staging.json_cell(F.col("p"), c.name, c.kind, kinds.spark_type(c)).alias(c.name) for c in kinds.columns])
    return found.withColumn("d", F.col("d").cast("string"))


@query("SELECT event_id, regexp_replace(strftime(ts - INTERVAL 5 HOUR - INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z' AS stamp FROM events")
def timestamptz_normalise(spark, sf):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+05:30"))
    return read(spark, sf, "events").select("event_id", payload.canonical_timestamptz(payload.parsed_timestamptz(text)).alias("stamp"))


# State: batches, backfills, promotion

LAST = f"""WITH {LOG}, last AS (SELECT k, arg_max(op, "offset") AS op, arg_max(v, "offset") AS v FROM log GROUP BY k) SELECT k, v FROM last WHERE op <> 'delete'"""
CHANGES = "generation string, lsn decimal(20,0), offset bigint, seq bigint, op string, k bigint, v double"


def store_at(spark: SparkSession, name: str) -> tuple[StateStore, int]:
    store = StateStore(spark, shared_folder(spark, name))
    return store, store.acquire()


def from_wire(records: DataFrame) -> DataFrame:
    """Records of the log as changes for a batch."""
    found = codec.checked(codec.decode(records.select("offset", "value")))
    e, c = F.col("envelope"), F.col("change")
    rows = found.select("offset", e["FragmentIndex"].alias("fragment"), e["Final"].alias("final"), F.posexplode(e["Changes"]).alias("seq", "change"))
    values = c["Row"]["Values"]
    return rows.select(
        c["Source"]["Generation"].alias("generation"), F.conv(F.split_part(c["Source"]["LSN"], F.lit("/"), F.lit(2)), 16, 10).cast("decimal(20,0)").alias("lsn"), "offset", "fragment", "final",
        F.col("seq").cast("bigint").alias("seq"), c["Op"].alias("op"), codec.cell(values[0], "bigint").alias("k"), codec.cell(values[1], "double").alias("v"),
    )


@query(LAST)
def apply_fragmented(spark, sf):
    """The whole log as fragments, in two batches of which the first ends inside a transaction; the first twenty are delivered twice."""
    found = wire_log(spark, sf, extra=20)
    end = found.bounds()["end_offset"]
    store, epoch = store_at(spark, "apply")
    store.commit({"target": spark.createDataFrame([], ACCOUNTS.schema())}, {"next_offset": 0}, epoch, store.version())
    cut = end // 2 | 1
    for start, size in ((0, cut), (cut, end - cut)):
        apply_batch(store, epoch, from_wire(found.poll(start, size)), "k", ["v"], buckets=4)
    return store.read("target")


def one_batch(spark, sf, low: int, high: int, at: int) -> DataFrame:
    """Events from `low` on and before `high` as transactions, one an offset from `at` on."""
    e = log(spark, sf).where(F.col("offset").between(low, high - 1))
    tx = F.floor(F.col("offset") / PER_TRANSACTION).cast("bigint")
    return e.select(
        F.lit("1").alias("generation"), F.lit(None).cast("decimal(20,0)").alias("lsn"), (tx - low // PER_TRANSACTION + at).alias("offset"), (F.col("offset") % PER_TRANSACTION).alias("seq"), "op", "k", "v",
    ).withColumn("lsn", F.col("offset").cast("decimal(20,0)"))


class Play:
    """A source whose log grows by a third of the events each time that a chunk is scanned."""

    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        self.store, self.epoch = store_at(spark, "backfill")
        self.jobs = backfill.Backfills(self.store, self.epoch, ACCOUNTS, buckets=4)
        self.n = read(spark, sf, "events").count()
        self.part = self.n // 30 * PER_TRANSACTION
        self.done = self.at = 0
        self.waiting: list[DataFrame] = []

    def mark(self, kind, lease) -> str:
        """A transaction of one marker at the end of the log."""
        name = f"{lease.job}:{lease.attempt}:{kind}:{lease.chunk_min}:{lease.chunk_max}:{self.at}"
        row = self.spark.sql(
            f"SELECT '1' AS generation, CAST({self.at} AS DECIMAL(20,0)) AS lsn, CAST({self.at} AS BIGINT) AS offset, 0L AS seq, 'marker' AS op, CAST(NULL AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS v, "
            f"named_struct('id', '{name}', 'kind', '{kind}', 'job_id', '{lease.job}', 'attempt', '{lease.attempt}', 'chunk_min', CAST('{lease.chunk_min}' AS BIGINT), 'chunk_max', CAST('{lease.chunk_max}' AS BIGINT)) AS marker"
        )
        self.waiting.append(row)
        self.at += 1
        return name

    def events(self, stop: int) -> None:
        if stop > self.done:
            self.waiting.append(one_batch(self.spark, self.sf, self.done, stop, self.at))
            self.at += -(-(stop - self.done) // PER_TRANSACTION)
            self.done = stop

    def scan(self, low, high) -> DataFrame:
        self.events(min(self.n, self.done + self.part))
        return snapshot(self.spark, self.sf).where(F.col("k").between(low, high))

    def follow(self) -> None:
        if self.waiting:
            rows = self.waiting[0]
            for more in self.waiting[1:]:
                rows = rows.unionByName(more, allowMissingColumns=True)
            self.waiting = []
            apply_batch(self.store, self.epoch, rows, "k", ["v"], buckets=4)

    def backfill(self, together: int = 1) -> None:
        self.jobs.start_live("accounts_live")
        self.jobs.create("job", "accounts_shadow", {"topic": "changes"})
        top = read(self.spark, self.sf, "customer").agg(F.max("c_custkey")).first()[0]
        manifest = self.spark.createDataFrame([(chunks.LEAST, top // 3), (top // 3 + 1, 2 * top // 3), (2 * top // 3 + 1, top)], "chunk_min bigint, chunk_max bigint")
        self.jobs.seal("job", manifest, top)
        run.run_backfill(self.jobs, "job", "worker", self.scan, self.mark, self.follow, shared_folder(self.spark, "stage"), together=together)


THIRDS = """win AS (SELECT * FROM (SELECT count(*) // 30 * 10 AS p FROM events) e, (SELECT max(c_custkey) AS m FROM customer) c, LATERAL (VALUES
  ((-9223372036854775807 - 1)::BIGINT, m // 3, -1), (m // 3 + 1, 2 * m // 3, p - 1), (2 * m // 3 + 1, m, 2 * p - 1)) t(chunk_min, chunk_max, low))"""
BACKFILLED = f"""WITH {LOG}, {SNAP}, {THIRDS},
last AS (SELECT k, arg_max(op, "offset") AS op, arg_max(v, "offset") AS v, max("offset") AS o FROM log GROUP BY k),
base AS (SELECT snap.k, snap.v, win.low FROM snap JOIN win ON snap.k BETWEEN win.chunk_min AND win.chunk_max)
SELECT coalesce(base.k, last.k) AS k, CASE WHEN base.low IS NOT NULL AND (last.o IS NULL OR last.o <= base.low) THEN base.v ELSE last.v END AS v
FROM base FULL OUTER JOIN last ON base.k = last.k WHERE (base.low IS NOT NULL AND (last.o IS NULL OR last.o <= base.low)) OR (last.k IS NOT NULL AND last.op <> 'delete')"""


@query(BACKFILLED)
def chunk_completion(spark, sf):
    """Three chunks, one after the other, while the log grows; then the rest of the log. The shadow table."""
    play = Play(spark, sf)
    play.backfill()
    play.events(play.n)
    play.follow()
    return play.store.read("accounts_shadow")


@query(BACKFILLED.replace("p - 1)", "-1)").replace("2 * -1)", "-1)"))
def parallel_backfill(spark, sf):
    """The same with all three chunks open at once: every LOW comes before the first scan."""
    play = Play(spark, sf)
    play.backfill(together=3)
    play.events(play.n)
    play.follow()
    return play.store.read("accounts_shadow")


@query(BACKFILLED)
def promoted_view(spark, sf):
    """A backfill validated at a marker, then the rest of the log, then promoted: what the live view shows."""
    play = Play(spark, sf)
    play.backfill()
    lease = backfill.Lease("job", "gen:1:attempt:1", 0, 0, "worker", 1)
    marker = play.mark("barrier", lease)
    play.follow()
    play.jobs.prepare_validation("job", marker)
    play.jobs.validate("job", play.store.read("accounts_shadow"))
    play.events(play.n)
    last = play.mark("barrier", lease)
    play.follow()
    changed = compare.changed_keys(log(spark, sf), "k", 0, play.n, 1 << 30)
    for _ in range(2):  # once more changes nothing
        play.jobs.promote("job", last, changed, play.store.read("accounts_shadow"))
    return play.jobs.live()


@query("""SELECT 'job' || (n_nationkey % 2) AS job_id, n_nationkey::BIGINT AS chunk_min, CASE WHEN n_nationkey % 3 = 0 THEN 'completed' ELSE 'pending' END AS status, CASE WHEN n_nationkey % 3 = 0 THEN 'gen:1:attempt:1' ELSE 'gen:1:attempt:2' END AS attempt FROM nation""")
def attempt_requeue(spark, sf):
    n = F.col("n_nationkey")
    rows = read(spark, sf, "nation").select(F.concat(F.lit("job"), n % 2).alias("job_id"), n.cast("bigint").alias("chunk_min"), F.when(n % 3 == 0, "completed").when(n % 3 == 1, "leased").otherwise("scanning").alias("status"), F.lit("gen:1:attempt:1").alias("attempt"))
    return backfill.new_attempt(rows, "gen:1:attempt:1")


@query("SELECT n_name AS job_id, 1::BIGINT AS completed, n_nationkey::BIGINT * 2 AS candidates, n_nationkey::BIGINT AS survivors FROM nation")
def chunk_counters(spark, sf):
    n = F.col("n_nationkey").cast("bigint")
    rows = read(spark, sf, "nation").select(F.col("n_name").alias("job_id"), F.explode(F.array(F.lit("completed"), F.lit("scanning"))).alias("status"), n.alias("rows_scanned"), n.alias("rows_applied"))
    return chunks.counters(rows)


@query(f"""WITH {LOG}, {SNAP}, cut AS (SELECT count(*) // 2 AS c FROM log), last AS (SELECT k, arg_max(op, "offset") AS op, arg_max(v, "offset") AS v FROM log, cut WHERE "offset" <= c GROUP BY k)
SELECT coalesce(snap.k, last.k) AS k, CASE WHEN last.k IS NULL THEN snap.v ELSE last.v END AS v FROM snap FULL OUTER JOIN last ON snap.k = last.k WHERE last.k IS NULL OR last.op <> 'delete'""")
def state_as_of(spark, sf):
    """The replica as of the middle of the log, with one chunk whose LOW comes before it."""
    n, top = read(spark, sf, "events").count(), read(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    window = spark.createDataFrame([(chunks.LEAST, top, -1, 0)], "chunk_min bigint, chunk_max bigint, low bigint, high bigint")
    return backfill.state_at(snapshot(spark, sf), log(spark, sf), window, "k", ["v"], n // 2)


@query(f"""WITH {LOG}, {SNAP}, cut AS (SELECT count(*) // 10 AS low, count(*) * 9 // 10 AS high FROM log), last AS (SELECT k, arg_max(op, "offset") AS op, arg_max(v, "offset") AS v, max("offset") AS o FROM log GROUP BY k)
SELECT coalesce(snap.k, last.k) AS k, CASE WHEN snap.k IS NOT NULL AND (last.k IS NULL OR last.o <= high) THEN snap.v ELSE last.v END AS v FROM cut, snap FULL OUTER JOIN last ON snap.k = last.k
WHERE (snap.k IS NOT NULL AND (last.k IS NULL OR last.o <= high)) OR (last.k IS NOT NULL AND last.op <> 'delete')""")
def stale_update(spark, sf):
    """The negative control: without eviction stale snapshot rows win over what happened during the scan."""
    n, top = read(spark, sf, "events").count(), read(spark, sf, "customer").agg(F.max("c_custkey")).first()[0]
    window = spark.createDataFrame([(chunks.LEAST, top, n // 10, n * 9 // 10)], "chunk_min bigint, chunk_max bigint, low bigint, high bigint")
    return reconcile.reconcile_in_steps(snapshot(spark, sf), log(spark, sf), window, "k", ["v"], evict=False).drop("origin")
