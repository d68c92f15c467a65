"""Settings, statements, the log, replication messages, canonical values and limits."""

import struct

import pytest
from pyspark.sql import functions as F

from tidelog.functions import payload
from tidelog.operators import markers, scan
from tidelog.sources import codec, config, ddl, wal
from tidelog.sources.contract import Column, TableContract, contract_of
from tidelog.sources.log import Log, LogError, bounded, start_faults
from tidelog.sources.state import StaleOwner

ACCOUNTS = TableContract("accounts", (Column("id", "int8", False), Column("owner", "text"), Column("balance", "int8")), "id")


# Replication messages


def text(value):
    return value.encode() + b"\0"


def cells(*values):
    out = struct.pack(">H", len(values))
    for v in values:
        out += b"n" if v is None else b"u" if v is wal.UNCHANGED else b"b\0\0\0\1x" if v is bytes else b"t" + struct.pack(">I", len(str(v).encode())) + str(v).encode()
    return out


def relation(number, name, columns, identity="f"):
    return b"R" + struct.pack(">I", number) + text("public") + text(name) + identity.encode() + struct.pack(">H", len(columns)) + b"".join(struct.pack(">B", int(c == "id")) + text(c) + struct.pack(">Ii", kind, -1) for c, kind in columns)


REL = relation(1, "accounts", [("id", 20), ("owner", 25), ("balance", 20)])
MARK = relation(2, "markers", [("id", 25), ("kind", 25)])


def begin(lsn):
    return b"B" + struct.pack(">QQI", lsn, 0, 7)


def commit(lsn):
    return b"C" + struct.pack(">BQQQ", 0, lsn, lsn + 1, 0)


def insert(number, *values):
    return b"I" + struct.pack(">I", number) + b"N" + cells(*values)


def update(old, *values):
    return b"U" + struct.pack(">I", 1) + (b"" if old is None else b"O" + cells(*old)) + b"N" + cells(*values)


def delete(kind, *values):
    return b"D" + struct.pack(">I", 1) + kind + cells(*values)


def test_wal_transactions():
    messages = [REL, MARK, begin(5), insert(1, 1, "a", None), update((1, "long", 3), 1, wal.UNCHANGED, None), commit(5), begin(6), b"Y", commit(6), begin(7), insert(2, "m", "low"), delete(b"O", 1, "long", None), commit(7)]
    found = list(wal.decoded(messages, ACCOUNTS))
    assert [(t.lsn, t.xid, t.changes) for t in found] == [
        (5, 7, [("insert", {"id": "1", "owner": "a", "balance": None}), ("update", {"id": "1", "owner": "long", "balance": None})]),
        (7, 7, [("marker", {"id": "m", "kind": "low"}), ("delete", {"id": "1", "owner": "long", "balance": None})]),
    ]


@pytest.mark.parametrize("messages,what", [
    ([REL, begin(5), update((1, "a", 1), 2, "a", 1)], "key of row"), ([REL, begin(5), update(None, 1, wal.UNCHANGED, 1)], "old value"), ([REL, begin(5), delete(b"K", 1, None, None)], "key only"),
    ([REL, begin(5), insert(1, 1, bytes, 1)], "kind"), ([REL, begin(5), b"T" + struct.pack(">IBI", 1, 0, 1)], "kind"), ([REL, insert(1, 1, "a", 1)], "outside"), ([REL, begin(5), begin(6)], "inside"), ([REL, begin(5), commit(6)], "another"),
    ([relation(1, "accounts", [("id", 20), ("owner", 25)])], "is not"), ([relation(1, "accounts", [("id", 20), ("owner", 25), ("balance", 20)], "d")], "identity"), ([relation(1, "accounts", [("id", 20), ("owner", 1043), ("balance", 20)])], "is not"),
    ([begin(5), insert(9, 1, "a", 1)], "unknown relation"), ([REL, begin(5), insert(1, 1, "a", 1), insert(1, 2, "a", 1), insert(1, 3, "a", 1)], "more than 2"),
])
def test_wal_errors(messages, what):
    with pytest.raises(wal.WalError, match=what):
        list(wal.decoded(messages, ACCOUNTS, max_events=2))


def test_wal_as_a_table(spark):
    messages = [REL, MARK, begin(5), insert(1, 1, "a", 9), commit(5), begin(6), insert(2, "m", "low"), commit(6)]
    rows = spark.createDataFrame([(s, i, m) for s in ("s1", "s2") for i, m in enumerate(messages)], "slot string, number int, data binary").orderBy(F.rand(3))
    found = wal.capture(rows, ACCOUNTS).orderBy("slot", "lsn").collect()
    assert [(r["slot"], r["lsn"], r["op"]) for r in found] == [(s, n, op) for s in ("s1", "s2") for n, op in ((5, "insert"), (6, "marker"))]
    assert found[0]["cells"] == {"id": "1", "owner": "a", "balance": "9"} and found[1]["marker"] == {"id": "m", "kind": "low"}


# The log


def test_log(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log")).create("t", "sys")
    assert log.create("other", "x").identity() == {"topic": "t", "system": "sys"}
    with pytest.raises(LogError):
        log.require_identity("t", "other")
    rows = lambda n, at: spark.createDataFrame([(f"k{at + i}", f"v{at + i}", at + i) for i in range(n)], "key string, value string, n int")
    leader = log.lead("one")
    assert log.append(rows(5, 0), ["n"], leader) == 5 and log.append(rows(3, 5), ["n"], leader) == 8
    log.lead("two")
    with pytest.raises(StaleOwner):
        log.append(rows(1, 8), ["n"], leader)
    assert [r["key"] for r in log.poll(4, 3).orderBy("offset").collect()] == ["k4", "k5", "k6"] and log.poll(8).count() == 0
    for start in (9, 100):
        with pytest.raises(LogError):
            log.poll(start)
    with pytest.raises(LogError):
        log.append(rows(1, 9).withColumn("value", F.repeat(F.lit("x"), codec.MAX_ENVELOPE + 1)), ["n"])
    log._fs.delete(log._path(f"{log.root}/segments/{0:020d}"), True)
    with pytest.raises(LogError, match="gone"):
        log.poll(4)
    with pytest.raises(LogError):
        bounded(log.records(), 2)
    assert bounded(log.records(), 3).count() == 3
    barriers = spark.createDataFrame([("b", "barrier", 6)], "id string, kind string, offset long")
    assert log.barrier(barriers, "b", 5) == 7
    with pytest.raises(LogError):
        log.barrier(barriers, "b", 7)


def test_segments_without_a_mark_do_not_count(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log")).create("t", "sys")
    one = spark.createDataFrame([("k", "v", 0)], "key string, value string, n int")
    log.append(one, ["n"])
    log._fs.delete(log._path(f"{log.root}/segments/{0:020d}/_SUCCESS"), True)
    assert log.bounds()["end_offset"] is None and log.append(one, ["n"]) == 1


def test_start_contract():
    slot = {"plugin": "pgoutput", "restart_lsn": "0/20"}
    assert start_faults(slot, {"t", "m"}, "t", "m", True, "0/20") == []
    assert len(start_faults({"plugin": "other"}, {"t"}, "t", "m", False)) == 3
    assert "behind" in start_faults(slot, {"t", "m"}, "t", "m", True, "0/1F")[0] and start_faults(None, {"t", "m"}, "t", "m", True) == ["the slot doesn't exist"]


# Settings and statements


def test_settings():
    s = {"A": " 5 ", "B": "x", "D": "1h30m", "E": "250ms", "F": "on", "G": "-2s"}
    assert config.whole_number(s, "A", 1) == 5 and config.whole_number(s, "Z", 1) == 1 and config.text(s, "Z", "d") == "d"
    assert config.seconds(s, "D", 0) == 5400 and config.seconds(s, "E", 0) == 0.25 and config.seconds(s, "G", 0) == -2 and config.flag(s, "F", False)
    for reader in (config.whole_number, config.seconds, config.flag):
        with pytest.raises(ValueError):
            reader(s, "B", 0)
    assert config.listed(" a, ,b ") == ["a", "b"] and config.least_budget(3) == 3 << 20 and config.least_budget(1 << 60) == (1 << 63) - 1
    assert config.address_fingerprint("x") != config.address_fingerprint("y") and len(config.address_fingerprint("x")) == 64


@pytest.mark.parametrize("wrong", [{"source": "a b"}, {"chunk_size": 0}, {"chunk_size": 200_000}, {"lease_seconds": 0}, {"heartbeat_seconds": 30.0}, {"workers": 100}, {"max_lag": -1}, {"adaptive": True}, {"max_records": 0}])
def test_backfill_config(wrong):
    config.BackfillConfig("a", "b")
    with pytest.raises(ValueError):
        config.BackfillConfig(**({"source": "a", "target": "b"} | wrong))


def test_config_from_text_and_warehouse():
    read = config.BackfillConfig.read({"TIDELOG_SOURCE": "a", "TIDELOG_TARGET": "b", "TIDELOG_CHUNK_SIZE": "7", "TIDELOG_LEASE_SECONDS": "3s"})
    assert (read.chunk_size, read.lease_seconds, read.heartbeat) == (7, 3.0, 1.0)
    good = {"database": "d", "schema": "s", "internal_schema": "i$", "live_table": "t", "stream": "x", "topic": "y"}
    config.WarehouseConfig(**good)
    for wrong in ({"schema": "a-b"}, {"stream": " "}, {"partition": 1}, {"loader": "z"}, {"parallel": 100}):
        with pytest.raises(ValueError):
            config.WarehouseConfig(**(good | wrong))


def test_statements(spark):
    assert ddl.object_path("db", "t$1") == '"DB"."T$1"' and ddl.column_list(ACCOUNTS) == "id, owner, balance"
    spark.sql(f"CREATE OR REPLACE TEMP VIEW texts AS SELECT {ddl.scan_list(ACCOUNTS)} FROM VALUES (1L, 'a', 5L) AS t(id, owner, balance)")
    assert spark.sql(f"SELECT {ddl.cast_list(ACCOUNTS)} FROM texts").dtypes == [("id", "bigint"), ("owner", "string"), ("balance", "bigint")]
    spark.sql(ddl.create_table(ACCOUNTS, "accounts_one"))
    spark.sql(ddl.create_view(ACCOUNTS, "accounts_view", "accounts_one"))
    assert spark.table("accounts_view").columns == ["id", "owner", "balance"] and ddl.require_empty(spark.table("accounts_view"), "x") is None
    with pytest.raises(ValueError):
        ddl.require_empty(spark.range(1), "x")
    assert 'PRIMARY KEY ("ID")' in ddl.create_warehouse_table(ACCOUNTS, "db", "s", "t")
    with pytest.raises(ValueError):
        ddl.create_warehouse_table(TableContract("t", (Column("id", "int8", False), Column("x", "bytea")), "id"), "t")
    old = spark.createDataFrame([("j", "a", 1, 2, "{}")], "job_id string, attempt string, chunk_min long, k long, payload string")
    assert ddl.migrated("candidates", old).first()["evicted"] is False and ddl.migrated("candidates", ddl.migrated("candidates", old)).columns == ddl.control_schema("candidates").names
    with pytest.raises(ValueError):
        ddl.migrated("candidates", old.drop("payload"))
    other = TableContract("accounts", (Column("id", "int8", False), Column("owner", "varchar"), Column("balance", "int8")), "id")
    assert ddl.swap_fault(ACCOUNTS, ACCOUNTS) is None and "owner" in ddl.swap_fault(ACCOUNTS, other)


def test_contract_of_a_table(spark):
    df = spark.createDataFrame([], "id bigint, a string, b boolean, c decimal(12,2), d timestamp, e date")
    found = contract_of(df, "t", "id")
    assert [c.kind for c in found.columns] == ["int8", "text", "bool", "numeric", "timestamptz", "date"] and found.check(df) is df
    with pytest.raises(ValueError):
        contract_of(spark.createDataFrame([], "id bigint, a array<int>"), "t", "id")


# Values


def test_canonical_json_is_exact(spark):
    same = [('{"b":1.0,"a":[true,null]}', '{"a":[true,null],"b":1}'), ("1e2", "100.00"), ("0.10", "1E-1"), ("-0", "0"), ('"é"', '"\\u00e9"')]
    differ = [("12345678901234567890123456789012345678901", "12345678901234567890123456789012345678902"), ("1e400", "1e401"), ("0.1", "0.10000000000000000001"), ("[1,2]", "[2,1]"), ('"1"', "1")]
    rows = spark.createDataFrame([(a, b) for a, b in same + differ], "a string, b string")
    found = rows.select((payload.canonical_json(F.col("a")) == payload.canonical_json(F.col("b"))).alias("e")).collect()
    assert [r["e"] for r in found] == [True] * len(same) + [False] * len(differ)
    for wrong in ("{", "NaN", "1e99999999", '{"a":}'):
        with pytest.raises(Exception, match="Error|JSON|digits"):
            spark.createDataFrame([(wrong,)], "a string").select(payload.canonical_json(F.col("a"))).collect()
    assert spark.createDataFrame([(None,)], "a string").select(payload.canonical_json(F.col("a"))).first()[0] is None


def test_timestamps(spark):
    one = spark.createDataFrame([("2026-09-30 12:13:14.12", "2026-09-30 12:13:14.120000+00")], "a string, b string")
    found = one.select(payload.canonical_timestamp(payload.parsed_timestamp(F.col("a"))).alias("a"), payload.canonical_timestamptz(payload.parsed_timestamptz(F.col("b"))).alias("b"))
    assert tuple(found.first()) == ("2026-09-30T12:13:14.12", "2026-09-30T12:13:14.12Z")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert one.select(payload.canonical_timestamptz(payload.parsed_timestamptz(F.lit("2026-09-30T17:43:14+05:30")))).first()[0] == "2026-09-30T12:13:14Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    for f, wrong in ((payload.parsed_timestamp, "2026-09-30"), (payload.parsed_timestamptz, "2026-09-30 12:13:14")):
        with pytest.raises(Exception, match="not a timestamp"):
            one.select(f(F.lit(wrong))).collect()


def test_canonical_values(spark):
    row = spark.sql("SELECT 5 AS i, true AS b, DATE'2020-01-02' AS d, '{\"a\": 1.0}' AS j")
    found = row.select(*[scan.canonical(F.col(c), k) for c, k in (("i", "int4"), ("b", "bool"), ("d", "date"), ("j", "jsonb"))]).first()
    assert tuple(found) == ("5", "t", "2020-01-02", '{"a":1}')
    with pytest.raises(ValueError):
        scan.canonical(F.col("i"), "float8")
    assert row.select(scan.typed(F.lit("\\x6162"), "binary", "bytea")).first()[0] == b"ab"
    with pytest.raises(Exception, match="boolean"):
        row.select(scan.typed(F.lit("yes"), "boolean", "bool")).collect()


def test_scan_limits(spark):
    rows = spark.createDataFrame([(i, "é" * 2) for i in range(10)], "id long, t string")
    assert scan.read_chunk(rows, "id", 2, 4, 3, 300).count() == 3
    for most, size in ((2, 1000), (3, 299)):
        with pytest.raises(scan.ScanLimit):
            scan.read_chunk(rows, "id", 2, 4, most, size)
    assert scan.read_chunk(rows, "id", 50, 60, 1, 1).count() == 0


def test_sizer():
    sizer = scan.Sizer(1000, 1.0, 100, 3000)
    assert [sizer.observe(s) for s in (0.5, 0.5, 0.5, 0.5, 4.0, 4.0, 4.0, 4.0)] == [1000, 1000, 2000, 3000, 3000, 3000, 3000, 1500]


def test_unknown_marker_kind(spark):
    wanted = spark.createDataFrame([("j", "a", "middle", 0, 9, 1)], "job_id string, attempt string, kind string, chunk_min long, chunk_max long, nanos long")
    with pytest.raises(Exception, match="unknown marker kind"):
        markers.written(wanted).collect()


def test_cells_that_stop(spark):
    row = spark.createDataFrame([("b", "x", "o")], "k string, t string, o string")
    with pytest.raises(Exception, match="cell kind"):
        row.select(codec.tuple_cell(F.col("k"), F.col("t"), F.col("o"))).collect()
    with pytest.raises(Exception, match="key changed"):
        row.select(codec.same_key(F.col("t"), F.col("o"))).collect()
