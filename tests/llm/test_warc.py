"""WARC archives: round trip, normaliser, revisits, damage."""

import gzip
import hashlib
import json
import zlib

import duckdb
import pytest

from pricelens.llm import files, warc
from pricelens.session import scratch_path


def pages(spark):
    big = "<html>" + "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 60
    rows = [(1, "http://a/1", big, 9), (7, "http://a/7 with space\r\nX: 1", big, 9), (3, None, big, 9), (4, "http://a/4", "small", 9), (5, "http://a/5", "small", 9),
            (6, "http://a/6", None, 9), (None, "http://a/n", big, 9), (7, "http://a/7 with space\r\nX: 1", big, 9), (8, "é", "日本" * 100_000, 9),
            (None, "u", "only nulls " * 200, 9), (None, "u", "only nulls " * 200, 9)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload int"), big


def test_round_trip_and_revisits(spark):
    df, big = pages(spark)
    folder = scratch_path(spark, "warc-test")
    out = warc.read(warc.normalise(warc.write(df.repartition(3), folder, file_bytes=4000), folder)).collect()
    assert len(out) == df.count()
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r)
        if r.record_type == "response":
            assert len(r.payload) == r.payload_bytes and hashlib.sha1(r.payload).hexdigest() == r.payload_digest and r.refers_to is None
        else:
            assert r.payload is None and r.refers_to == 7 and r.payload_bytes == len(big) and r.payload_digest == hashlib.sha1(big.encode()).hexdigest()
    kinds = {i: sorted(r.record_type for r in rs) for i, rs in by.items()}
    assert kinds == {1: ["revisit"], 3: ["revisit"], 7: ["response"] * 2, 4: ["response"], 5: ["response"], 6: ["response"], 8: ["response"],
                     None: ["response", "response", "revisit"]}
    assert by[6][0].payload == b"" and by[3][0].url is None and by[7][0].url == "http://a/7%20with%20space%0D%0AX:%201"


def test_members_and_sidecar(spark):
    df, _ = pages(spark)
    folder = scratch_path(spark, "warc-test")
    mono = warc.write(df.coalesce(1), folder, file_bytes=1 << 30)
    (m,) = mono.collect()
    inflate = zlib.decompressobj(31)
    inflate.decompress(files.read_all(m.file))
    assert inflate.eof and not inflate.unused_data  # one stream
    (n,) = warc.normalise(mono, folder).collect()
    data, at, ids = files.read_all(n.file), 0, []
    for line in files.read_all(n["index"]).splitlines():
        e = json.loads(line)
        assert e["offset"] == at
        record = gzip.decompress(data[at:at + e["length"]])
        assert warc.parse(record)[0]["warc-record-id"] == e["id"]
        at += e["length"]
        ids.append(e["type"])
    assert at == len(data) and len(ids) == n.records == df.count() + 1 and ids[0] == "warcinfo"
    assert b"".join(warc.records(n.file)) == b"".join(warc.records(m.file))  # the normaliser reads members too


def test_empty_and_damaged(spark):
    df, _ = pages(spark)
    folder = scratch_path(spark, "warc-test")
    assert warc.read(warc.normalise(warc.write(df.limit(0), folder), folder)).count() == 0
    (m,) = warc.write(df.coalesce(1), folder).collect()
    whole = gzip.decompress(files.read_all(m.file))
    for bad in (whole[:-7], whole.replace(b"WARC/1.1", b"XARC/1.1", 1)):
        w = files.Writer(folder, "bad", ".warc.gz")
        w.write(gzip.compress(bad))
        w.close()
        with pytest.raises(ValueError):
            list(warc.records(w.uri, chunk=1000))


def test_query_equals_sql(spark):
    from conftest import SF_SMALL, rows
    from pricelens.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF_SMALL}/pages.parquet'")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert rows(QUERIES["op5_warc"](spark, SF_SMALL), *cols) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL['op5_warc']})").fetchall())
