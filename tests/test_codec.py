"""Envelopes: decoding, guards and fragmenting."""

import json

import pytest

from tidelog.sources import codec

SOURCE = {"Generation": "g", "SystemID": "s", "XID": 7, "LSN": "0/10"}


def envelope(**changes):
    change = {"Op": "insert", "SchemaID": "e", "Row": {"Values": [{"Kind": 1, "Int": 5, "Text": ""}, {"Kind": 0, "Int": 0, "Text": ""}]}, "Marker": None, "Source": SOURCE}
    return {"Version": 2, "SchemaID": "e", "FragmentIndex": 0, "Final": True, "Count": 1, "TotalCount": 1, "Source": SOURCE, "Changes": [change]} | changes


@pytest.mark.parametrize("body,fault", [
    (envelope(), None), (envelope(Version=3), "unknown version"), (envelope(Count=2, TotalCount=2), "count differs"), (envelope(TotalCount=0), "total below count"),
    (envelope(SchemaID="x"), "mixed schemas"), (envelope(Source=SOURCE | {"LSN": ""}), "missing identity"), ("{", "malformed"),
])
def test_faults(spark, body, fault):
    log = spark.createDataFrame([(0, body if isinstance(body, str) else json.dumps(body))], "offset bigint, value string")
    assert codec.decode(log).first()["fault"] == fault


def test_cells(spark):
    log = spark.createDataFrame([(0, json.dumps(envelope()))], "offset bigint, value string")
    values = codec.changes(codec.checked(codec.decode(log))).select("change.Row.Values")
    row = values.select(codec.cell(values["Values"][0], "bigint").alias("id"), codec.cell(values["Values"][1], "string").alias("owner")).first()
    assert (row["id"], row["owner"]) == (5, None)


def test_fragments(spark):
    rows = [("t", i, n) for i, n in enumerate([40, 40, 30, 90, 10])]
    found = codec.fragment_numbers(spark.createDataFrame(rows, "tx string, seq int, bytes int"), ["tx"], "seq", "bytes", 100).orderBy("seq").collect()
    assert [r["fragment"] for r in found] == [0, 0, 1, 2, 2]
