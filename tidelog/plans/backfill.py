"""Backfill jobs in the state store: jobs, chunks and routes; leases; chunks from scan to completion; validation; promotion.

Every step is one commit of the store, guarded by the state, owner and token that it expects, so it happens once or not at
all. Jobs and routes are facts of the commit record (a few small records); chunks, markers, stages, targets and clocks are
tables.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidelog.operators import chunks as ranges, compare, fold, markers as marks, reconcile
from tidelog.plans.apply import BUCKETS
from tidelog.sources import ddl, staging
from tidelog.sources.contract import TableContract, identifier
from tidelog.sources.state import Buckets, Change, StateStore, bucket_number

#: Job states and the states that may follow each; chunk states in order.
JOB_STATES = {
    "discovering": {"running", "failed"}, "running": {"ready_to_verify", "failed"}, "ready_to_verify": {"verifying", "failed"}, "verifying": {"ready", "failed"},
    "ready": {"promoting", "failed"}, "promoting": {"completed", "failed"}, "completed": set(), "failed": set(),
}
CHUNK_STATES = ("pending", "leased", "scanning", "reconciling", "committing", "completed")
HELD = ("leased", "scanning", "committing")
CHUNKS = "job_id string, attempt string, chunk_min bigint, chunk_max bigint, status string, owner string, token bigint, expires double, low_marker string, high_marker string, low_lsn decimal(20,0), stage string, rows_scanned bigint, rows_applied bigint"
CHUNK_KEY = ("job_id", "chunk_min")


class JobError(RuntimeError):
    """A job, chunk or lease isn't in the state that a step needs."""


def advance(state: str, to: str) -> str:
    """The next state; the same again is allowed, so that a retry is harmless."""
    if to != state and to not in JOB_STATES[state]:
        raise ValueError(f"a job that is {state} can't become {to}")
    return to


def next_attempt(attempt: str) -> str:
    m = re.fullmatch(r"gen:(\d+):attempt:(\d+)", attempt)
    if not m:
        raise ValueError(f"malformed attempt: {attempt!r}")
    return f"gen:{m[1]}:attempt:{int(m[2]) + 1}"


def new_attempt(chunks: DataFrame, attempt: str) -> DataFrame:
    """Completed chunks stay; all others wait anew under the next attempt."""
    open_ = F.col("status") != "completed"
    return chunks.withColumn("attempt", F.when(open_, F.lit(next_attempt(attempt))).otherwise(F.col("attempt"))).withColumn("status", F.when(open_, "pending").otherwise(F.col("status")))


def state_at(snapshot: DataFrame, changes: DataFrame, windows: DataFrame, key: str, values: list[str], offset: int) -> DataFrame:
    """The replica as of a log offset, which is a function of the snapshot and the log up to it: no fence is needed."""
    return reconcile.reconcile(snapshot, changes.where(changes["offset"] <= offset), windows, key, values).drop("origin")


def validate(source: DataFrame, shadow: DataFrame, key: str) -> None:
    """Raises at the first key at which the tables differ."""
    found = compare.first_difference(source, shadow, key).collect()
    if found:
        raise ValueError(f"{found[0]['kind']} at key {found[0][key]}")


def common_offset(frontiers: list[int], gate: int | None = None) -> int:
    """The offset to which several jobs can be brought: none may be behind it for good, so it is the greatest of them, or the gate."""
    target = max(frontiers)
    if gate is not None and gate < target:
        raise JobError(f"a job is at {target}, past the gate {gate}")
    return target if gate is None else gate


@dataclass(frozen=True)
class Lease:
    job: str
    attempt: str
    chunk_min: int
    chunk_max: int
    owner: str
    token: int


class Backfills:
    """The jobs of one store. `clock` gives the time in seconds, by which leases end."""

    def __init__(self, store: StateStore, epoch: int, contract: TableContract, clock: Callable[[], float] = time.time, buckets: int = BUCKETS, failpoint: Callable[[str], None] = lambda name: None):
        self.store, self.epoch, self.contract, self.clock, self.buckets, self.failpoint = store, epoch, contract, clock, buckets, failpoint
        self._numbers: dict[tuple[str, int], int] = {}

    # Jobs

    def jobs(self) -> dict[str, dict]:
        return self.store.facts().get("jobs", {})

    def job(self, name: str, *states: str) -> dict:
        found = self.jobs().get(name)
        if found is None:
            raise JobError(f"no job {name}")
        if states and found["state"] not in states:
            raise JobError(f"job {name} is {found['state']}, not {' or '.join(states)}")
        return found

    def routes(self) -> dict[str, dict]:
        return self.store.facts().get("routes", {})

    def _commit(self, change: Change, jobs: dict | None = None, routes: dict | None = None) -> int:
        facts = self.store.facts()
        if jobs:
            change.facts["jobs"] = facts.get("jobs", {}) | jobs
        if routes:
            change.facts["routes"] = facts.get("routes", {}) | routes
        return self.store.commit(change, epoch=self.epoch, expected=self.store.version(), before_commit=lambda: self.failpoint("before_commit"))

    def start_live(self, table: str, empty: bool = True) -> None:
        """Register the live table and its route; a fresh target must be empty."""
        rows = self.store.read(table)
        if empty and rows is not None:
            ddl.require_empty(rows, table)
        tables = {} if rows is not None else {identifier(table): self.store.spark.createDataFrame([], self.contract.schema())}
        self._commit(Change(tables=tables, facts={"view": table}), routes={"live": {"target": table, "active": True}})

    def create(self, name: str, shadow: str, pins: dict, attempt: str = "gen:1:attempt:1") -> dict:
        """A job that discovers its chunks, with an empty shadow table and an active route to it.

        The route is there before the key bound is read, so no change can fall between. A table serves one active job.
        """
        live = self.routes()["live"]["target"]
        next_attempt(attempt)  # malformed ones raise
        if not name.strip() or identifier(shadow).lower() == live.lower():
            raise JobError(f"a job needs a name, and a shadow table other than {live}")
        same = self.jobs().get(name)
        if same is not None:
            if (same["shadow"], same["pins"], same["attempt"]) != (shadow, pins, attempt):
                raise JobError(f"job {name} exists, and is another")
            return same
        for other, j in self.jobs().items():
            if j["state"] not in ("completed", "failed") and j["shadow"].lower() == shadow.lower():
                raise JobError(f"table {shadow} is taken by job {other}")
        job = {"state": "discovering", "attempt": attempt, "live": live, "shadow": shadow, "pins": pins, "start_offset": self.store.facts().get("next_offset", 0), "schema": self.contract.fingerprint()}
        empty = self.store.spark.createDataFrame([], self.contract.schema())
        self._commit(Change(tables={shadow: empty}), {name: job}, {self.route(name): {"target": shadow, "active": True}})
        return job

    @staticmethod
    def route(job: str) -> str:
        return f"shadow_{job}"

    def seal(self, name: str, manifest: DataFrame, upper: int) -> int:
        """Prove a manifest (chunk_min, chunk_max), store it and let the job run, in one commit; its number of chunks."""
        job = self.job(name, "discovering", "running")
        if job["state"] == "running":
            return job["chunks"]
        faults = ranges.manifest_faults(manifest, upper).limit(1).collect()
        if faults or manifest.isEmpty():
            raise JobError(f"the manifest is not proven: {faults[0]['fault'] if faults else 'it is empty'}")
        nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("owner", "string"), ("low_marker", "string"), ("high_marker", "string"), ("low_lsn", "decimal(20,0)"), ("stage", "string"), ("expires", "double"))]
        rows = manifest.select(
            F.lit(name).alias("job_id"), F.lit(job["attempt"]).alias("attempt"), "chunk_min", "chunk_max", F.lit("pending").alias("status"), F.lit(0).cast("bigint").alias("token"),
            *nothing, F.lit(0).cast("bigint").alias("rows_scanned"), F.lit(0).cast("bigint").alias("rows_applied"),
        ).select(*[c.split()[0] for c in CHUNKS.split(", ")]).persist()
        others = self.store.read("chunks")
        n = rows.count()
        whole = rows if others is None else others.where(F.col("job_id") != name).unionByName(rows)
        self._commit(Change(buckets={"chunks": Buckets(whole, CHUNK_KEY, self.buckets)}), {name: job | {"state": advance(job["state"], "running"), "upper_bound": upper, "chunks": n}})
        rows.unpersist()
        return n

    def chunks(self, name: str) -> DataFrame:
        return self.store.read("chunks").where(F.col("job_id") == name)

    def progress(self, name: str) -> dict:
        """State, chunks by status and the end of the completed prefix."""
        job, rows = self.job(name), self.chunks(name)
        done = ranges.contiguous_frontier(rows.withColumn("completed", F.col("status") == "completed")).first()
        counts = {r["status"]: r["count"] for r in rows.groupBy("status").count().collect()}
        return {"state": job["state"], "attempt": job["attempt"], "chunks": counts, "completed_through": done["completed_through"], "next_offset": self.store.facts().get("next_offset", 0)}

    # Leases

    def _bucket(self, name: str, chunk_min: int) -> tuple[int, ...]:
        if (name, chunk_min) not in self._numbers:
            row = self.store.spark.range(1).select(bucket_number([F.lit(name), F.lit(chunk_min).cast("bigint")], self.buckets))
            self._numbers[name, chunk_min] = row.first()[0]
        return (self._numbers[name, chunk_min],)

    def _update(self, lease: Lease, where: Column, values: dict, change: Change | None = None, jobs: dict | None = None) -> None:
        """Set columns of the lease's chunk if it is as `where` says; else the lease is lost."""
        touched = self._bucket(lease.job, lease.chunk_min)
        rows = self.store.read_buckets("chunks", touched)
        mine = (F.col("job_id") == lease.job) & (F.col("attempt") == lease.attempt) & (F.col("chunk_min") == lease.chunk_min) & where
        if rows.where(mine).count() != 1:
            raise JobError(f"chunk {lease.chunk_min} to {lease.chunk_max}: the lease is lost, or the chunk is in another state")
        kinds = dict(rows.dtypes)
        new = rows.select(*[F.when(mine, values[c] if isinstance(values[c], Column) else F.lit(values[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in rows.columns])
        change = change or Change()
        change.buckets["chunks"] = Buckets(new, CHUNK_KEY, self.buckets, touched)
        self._commit(change, jobs)

    def _held(self, lease: Lease, *states: str) -> Column:
        return (F.col("owner") == lease.owner) & (F.col("token") == lease.token) & (F.col("expires") > self.clock()) & F.col("status").isin(*states)

    def lease(self, name: str, owner: str, seconds: float) -> Lease | None:
        """The first chunk that waits or whose lease has ended; its token rises, which fences the one before. None: no chunk is free."""
        job = self.job(name, "running")
        if not owner or seconds <= 0:
            raise JobError("a lease needs an owner and a duration")
        free = (F.col("status") == "pending") | (F.col("status").isin(*HELD) & (F.col("expires") <= self.clock()))
        found = self.chunks(name).where((F.col("attempt") == job["attempt"]) & free).orderBy("chunk_min").limit(1).collect()
        if not found:
            return None
        r = found[0]
        lease = Lease(name, job["attempt"], r["chunk_min"], r["chunk_max"], owner, r["token"] + 1)
        cleared = dict.fromkeys(("low_marker", "high_marker", "low_lsn", "stage")) | {"rows_scanned": 0, "rows_applied": 0}
        self._update(lease, F.col("token") == r["token"], cleared | {"status": "leased", "owner": owner, "token": lease.token, "expires": self.clock() + seconds})
        return lease

    def renew(self, lease: Lease, seconds: float) -> None:
        self._update(lease, self._held(lease, *HELD), {"expires": self.clock() + seconds})

    def release_expired(self, name: str, before: float) -> int:
        """Chunks whose lease ended before a time wait again; their number."""
        rows = self.store.read("chunks")
        late = (F.col("job_id") == name) & F.col("status").isin(*HELD) & (F.col("expires") < before)
        n = rows.where(late).count()
        if n:
            new = rows.withColumn("status", F.when(late, "pending").otherwise(F.col("status"))).withColumn("owner", F.when(~late, F.col("owner")))
            self._commit(Change(buckets={"chunks": Buckets(new, CHUNK_KEY, self.buckets)}))
        return n

    def new_attempt(self, name: str) -> str:
        """Bump the attempt; chunks that aren't completed wait anew."""
        job = self.job(name, "running")
        attempt, rows = next_attempt(job["attempt"]), self.store.read("chunks")
        mine = rows.where(F.col("job_id") == name)
        new = rows.where(F.col("job_id") != name).unionByName(new_attempt(mine, job["attempt"]))
        self._commit(Change(buckets={"chunks": Buckets(new, CHUNK_KEY, self.buckets)}), {name: job | {"attempt": attempt}})
        return attempt

    # A chunk from scan to completion

    def begin_scan(self, lease: Lease, low_marker: str) -> None:
        if not low_marker:
            raise JobError("a scan starts with a LOW marker")
        self._update(lease, self._held(lease, "leased"), {"status": "scanning", "low_marker": low_marker, "high_marker": None, "stage": None, "rows_scanned": 0})

    def stage(self, lease: Lease, rows: DataFrame, folder: str) -> int:
        """Stage what the scan read. A retry of the same rows finds the same file."""
        path, n = staging.stage(rows, self.contract, folder, "live", lease.job, lease.attempt, lease.chunk_min)
        self._update(lease, self._held(lease, "scanning"), {"stage": path, "rows_scanned": n})
        return n

    def seal_scan(self, lease: Lease, high_marker: str) -> None:
        if not high_marker:
            raise JobError("a scan ends with a HIGH marker")
        self._update(lease, self._held(lease, "scanning") & F.col("low_marker").isNotNull() & F.col("stage").isNotNull(), {"status": "committing", "high_marker": high_marker})

    def finalise(self, lease: Lease) -> int:
        """Put the surviving rows of a chunk in the shadow table and complete it, in one commit; the number of rows.

        Both markers must have been applied. A key with a change after LOW, a delete too, is left to the log.
        """
        job, spark = self.job(lease.job, "running"), self.store.spark
        touched = self._bucket(lease.job, lease.chunk_min)
        mine = (F.col("job_id") == lease.job) & (F.col("chunk_min") == lease.chunk_min) & self._held(lease, "committing")
        row = self.store.read_buckets("chunks", touched).where(mine).first()
        if row is None:
            raise JobError(f"chunk {lease.chunk_min}: the lease is lost, or the scan isn't sealed")
        seen = self.store.read("markers")
        at = {}
        for name in (row["low_marker"], row["high_marker"]):
            mark = None if seen is None else seen.where((F.col("id") == name) & (F.col("job_id") == lease.job) & (F.col("attempt") == lease.attempt) & (F.col("chunk_min") == lease.chunk_min) & (F.col("chunk_max") == lease.chunk_max)).orderBy("offset").first()
            if mark is None:
                raise JobError(f"marker {name} is not applied")
            at[name] = mark["lsn"]
        key, route = self.contract.key, self.route(lease.job)
        rows = staging.staged_rows(staging.load_lines(spark, row["stage"]), self.contract, row["rows_scanned"])
        count = self.store.bucket_count(f"clocks_{route}", self.store.bucket_count(job["shadow"], self.buckets))
        buckets = tuple(r[0] for r in rows.select(bucket_number([key], count)).distinct().collect())
        clocks = self.store.read_buckets(f"clocks_{route}", buckets)
        low = F.lit(at[row["low_marker"]]).cast("decimal(20,0)")
        if clocks is None:
            clocks = spark.createDataFrame([], f"{key} bigint, lsn decimal(20,0)")
        kept = reconcile.surviving_candidates(rows.withColumn("low", low), clocks.select(key, "lsn"), [key]).drop("low").persist()
        n = kept.count()
        change = Change()
        if n:
            target = self.store.read_buckets(job["shadow"], buckets)
            whole = self.store.commit_record()["tables"][job["shadow"]]["kind"] != "buckets"
            merged = target.join(kept.select(key), key, "left_anti").select(*kept.columns).unionByName(kept)
            change.buckets[job["shadow"]] = Buckets(merged, (key,), count, None if whole else buckets)
        left = self.chunks(lease.job).where((F.col("status") != "completed") & (F.col("chunk_min") != lease.chunk_min)).count()
        jobs = {lease.job: job | {"state": advance(job["state"], "ready_to_verify")}} if not left else None
        self._update(lease, self._held(lease, "committing"), {"status": "completed", "low_lsn": low, "stage": None, "rows_applied": n, "expires": None}, change, jobs)
        kept.unpersist()
        staging.clear(spark, row["stage"])  # after the commit: no chunk points to it any more
        return n

    # Validation and promotion

    def _marker(self, marker: str) -> int:
        seen = self.store.read("markers")
        found = None if seen is None else marks.position(seen, marker).first()
        if found is None:
            raise JobError(f"marker {marker} is not applied")
        return found["offset"]

    def prepare_validation(self, name: str, marker: str) -> dict:
        """Pin the shadow table as of a marker: the store's versions don't change, so a version is the clone."""
        offset, job = self._marker(marker), self.job(name, "ready_to_verify", "verifying", "completed")
        if job["state"] == "completed" or job.get("validation", {}).get("marker") == marker:
            return job
        version = self.store.version()
        if self.store.facts(version)["next_offset"] != offset + 1:
            raise JobError(f"the replica is at {self.store.facts(version)['next_offset']}, not just behind marker {marker}")
        job = job | {"state": advance(job["state"], "verifying"), "validation": {"marker": marker, "offset": offset, "version": version}}
        self._commit(Change(), {name: job})
        return job

    def validate(self, name: str, source: DataFrame) -> None:
        """Compare the source, as of the validation's marker, with the pinned shadow table; a difference fails the job."""
        job = self.job(name, "verifying")
        shadow = self.store.read(job["shadow"], job["validation"]["version"])
        try:
            validate(source, shadow.select(*source.columns), self.contract.key)
        except ValueError as e:
            self.fail(name, str(e))
            raise
        self._commit(Change(), {name: job | {"state": advance(job["state"], "ready")}})

    def fail(self, name: str, cause: str) -> None:
        """The job ends; its route is switched off, so that nothing more is written to the shadow table."""
        job = self.job(name)
        if job["state"] == "completed":
            return
        self._commit(Change(), {name: job | {"state": "failed", "error": cause or "unknown failure"}}, {self.route(name): self.routes()[self.route(name)] | {"active": False}})

    def promote(self, name: str, marker: str, changed: DataFrame, source: DataFrame) -> str:
        """Make the shadow table the live one at a marker; the name of the table that is retired.

        Keys changed since the validation are compared once more. Intent and effect are two commits: a crash between them is
        finished by promoting again at the same marker; at another one that raises.
        """
        offset, job = self._marker(marker), self.job(name, "ready", "promoting", "completed")
        if job.get("promotion", {"offset": offset, "marker": marker}) != {"offset": offset, "marker": marker}:
            raise JobError(f"job {name} is promoted at another marker")
        if job["state"] == "completed":
            return job["retired"]
        key = self.contract.key
        wrong = compare.compare_keys(changed, source, self.store.read(job["shadow"]).select(*source.columns), key).where("NOT equal").limit(1).collect()
        if wrong:
            raise JobError(f"key {wrong[0][key]} differs after validation")
        if job["state"] == "ready":
            job = job | {"state": advance(job["state"], "promoting"), "promotion": {"offset": offset, "marker": marker}}
            self._commit(Change(), {name: job})
        self.failpoint("promotion_intent")
        retired, routes = self.routes()["live"]["target"], self.routes()
        clocks = self.store.read(f"clocks_{self.route(name)}")
        change = Change(facts={"view": job["shadow"]})
        if clocks is not None:
            change.buckets["clocks_live"] = Buckets(clocks, (key,), self.store.bucket_count(job["shadow"], self.buckets))
        self._commit(
            change, {name: job | {"state": advance(job["state"], "completed"), "retired": retired}},
            {"live": routes["live"] | {"target": job["shadow"], "active": True}, self.route(name): routes[self.route(name)] | {"active": False}},
        )
        return retired

    def live(self) -> DataFrame:
        """What readers see: the table that the durable view points to."""
        return self.store.read(self.store.facts()["view"])

    def recover(self, name: str, pins: dict, earliest: int) -> dict:
        """Checks before a job goes on: same source and schema, a log that still holds its frontier, chunks that fit its state."""
        job = self.job(name)
        if job["pins"] != pins or job["schema"] != self.contract.fingerprint():
            raise JobError(f"job {name} belongs to another source or schema")
        frontier = self.store.facts().get("next_offset", 0)
        if frontier < earliest:
            raise JobError(f"offset {frontier} is gone; the log starts at {earliest}")
        if job["state"] == "ready_to_verify" and not self.chunks(name).where(F.col("status") != "completed").isEmpty():
            raise JobError(f"job {name} has open chunks")
        return dict(job)
