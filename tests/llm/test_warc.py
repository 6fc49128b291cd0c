"""WARC source: round trips, revisits, predicates, skipped payloads, foreign archives."""

import base64
import gzip
import hashlib
import os
import random

import pytest

from wordloom.llm import warc
from wordloom.session import scratch_path

LONG = "<p>é " + "copy " * 400


def some(n=60):
    r = random.Random(4)
    rows = [(i, f"http://h{i % 7}.example.org/ü?p={i}", "<html>" + "".join(r.choices("abc é\r\n", k=r.randint(0, 4000)))) for i in range(n)]
    return rows + [(100 + i, "http://copy.example.org/", LONG) for i in range(9)] + [(300, None, "short copy"), (301, "http://a b\r\nX-Page-Id: 9", "short copy"),
                                                                                     (302, "u", None), (303, "u", ""), (None, "u", LONG), (304, "u", "x" * 1000),
                                                                                     (305, "u", "x" * 1000), (306, "u", "x" * 999), (307, "u", "x" * 999),
                                                                                     (304, "u", "x" * 1000), (400, "u", "WARC/1.1\r\n\r\n" * 50_000)]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", b"z") for r in rows], "page_id long, url string, html string, digest string, top string, payload binary")


def expected(rows):
    held = {}
    for i, _, html in rows:
        held.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        known = [x for x in held[html or ""] if x is not None]
        top = max(known) if known else None
        again = len(body) >= 1000 and i != top
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


@pytest.fixture(scope="module")
def archive(spark):
    path = scratch_path(spark, "test-archive")
    warc.write_archive(table(spark, some()).repartition(3), path, rollBytes=20_000)
    return path


def files(path):
    top = path.removeprefix("file:")
    return sorted(os.path.join(top, f) for f in os.listdir(top))


def test_round_trip(spark, archive):
    assert got(warc.digest_report(spark, archive)) == expected(some())
    assert len(files(archive)) > 3 and all(f.endswith(".warc.gz") for f in files(archive))


def test_payloads_and_headers_come_back(spark, archive):
    rows = warc.read_archive(spark, archive, ["page_id", "record_type", "target_uri", "payload"]).where("page_id is not null").collect()
    texts = {i: t or "" for i, _, t in some()}
    for r in rows:
        assert r["payload"] is None if r["record_type"] == "revisit" else r["payload"].decode() == texts[r["page_id"]]
    uris = {r["page_id"]: r["target_uri"] for r in rows}
    assert uris[300] is None and uris[301] == "http://a%20b%0D%0AX-Page-Id:%209" and uris[5].endswith("/ü?p=5")


def test_own_files_are_gzip(archive):
    text = gzip.open(files(archive)[0]).read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n") and text.endswith(b"\r\n\r\n")


def test_predicates_are_pushed_down(spark, archive):
    all_rows = warc.read_archive(spark, archive, ["page_id", "record_type", "target_uri", "refers_to", "payload_bytes"])
    for test in ("record_type = 'revisit'", "record_type in ('revisit', 'response') and page_id >= 40", "target_uri like 'http://h3%'", "refers_to = 108 and page_id < 104",
                 "page_id is null", "payload_bytes > 2000 and record_type = 'response'", "record_type <> 'response'"):
        frame = all_rows.where(test)
        kept = [r for r in all_rows.collect() if eval_row(spark, r, all_rows.schema, test)]
        assert sorted(map(str, frame.collect())) == sorted(map(str, kept))
    plan = all_rows.where("record_type = 'revisit' and page_id > 3")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]


def eval_row(spark, row, schema, test):
    import duckdb
    names = [f.name for f in schema.fields]
    kinds = {"string": "varchar", "bigint": "bigint"}
    casts = ", ".join(f"cast(? as {kinds[f.dataType.simpleString()]}) as {f.name}" for f in schema.fields)
    return duckdb.execute(f"select count(*) from (select {casts}) where {test}", [row[n] for n in names]).fetchone()[0] == 1


def test_payloads_that_nobody_asks_for_are_not_inflated(spark, tmp_path):
    made = [warc.member(warc.page_record(i, "u", b"payload " * 5000, "0" * 40, "response", None, "d"), 6) for i in range(5)]
    broken = [m[:600] + bytes(40) + m[640:] if len(m) > 700 else m[:-60] + bytes(52) + m[-8:] for m in made]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(broken))
    columns = ["page_id", "record_type"]
    assert warc.read_archive(spark, str(tmp_path), columns).count() == 5
    with pytest.raises(Exception):
        warc.read_archive(spark, str(tmp_path), [*columns, "payload"]).collect()


def test_foreign_archives(spark, tmp_path):
    digest = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    one = warc.record("response", b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\nbody", [("WARC-Target-URI", "http://a/"), ("WARC-Payload-Digest", "sha1:" + digest),
                                                                               ("Content-Type", "application/http")])
    two = warc.record("resource", b"plain\r\n\r\nbytes", [("warc-target-uri", "http://b/"), ("Content-Type", "text/plain")])
    folded = b"WARC/1.0\r\nWARC-Type: metadata\r\nX-Note: a\r\n b\r\nWARC-Target-URI: http://c/\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(one + two + folded)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two) + gzip.compress(folded))
    (tmp_path / "_c.warc").write_bytes(b"not read")
    (tmp_path / "d.txt").write_bytes(b"not read")
    rows = warc.read_archive(spark, str(tmp_path), ["target_uri", "record_type", "payload_bytes", "payload_digest", "payload"], partitionBytes=1).collect()
    want = [("http://a/", "response", 4, hashlib.sha1(b"body").hexdigest(), b"body"), ("http://b/", "resource", 14, None, b"plain\r\n\r\nbytes"),
            ("http://c/", "metadata", 3, None, b"abc")]
    assert sorted((tuple(r) for r in rows), key=str) == sorted([(a, b, c, d, bytearray(e)) for a, b, c, d, e in want] * 2, key=str)
    assert warc.read_archive(spark, str(tmp_path), ["target_uri"]).where("target_uri = 'http://b/'").count() == 2
    assert warc.read_archive(spark, str(tmp_path / "a.warc"), ["record_type"]).count() == 3


def test_plan_deals_files_by_size(tmp_path):
    for i, n in enumerate([900, 10, 20, 30, 500, 400]):
        (tmp_path / f"{i}.warc").write_bytes(bytes(n))
    from pyspark.sql import types as T
    reader = warc.WarcReader(str(tmp_path), ["page_id"], T.StructType([T.StructField("page_id", T.LongType())]), 500)
    sizes = [sum(os.path.getsize(f) for f in p.files) for p in reader.partitions()]
    assert sorted(sizes) == [460, 500, 900]


def test_failed_attempts_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    writer = warc.WarcWriter(path, "d", 1, 1 << 20)
    import pyarrow as pa
    cols = [pa.array([1]), pa.array(["u"]), pa.array([b"p"]), pa.array(["0" * 40]), pa.array(["response"]), pa.array([None], pa.int64())]
    b = pa.record_batch(cols, names=["page_id", "url", "payload", "payload_digest", "record_type", "refers_to"])
    writer.write(iter([b]))
    writer.commit([writer.write(iter([b])), writer.write(iter([]))])
    assert len(os.listdir(path)) == 1
    assert warc.read_archive(spark, path, ["page_id"]).where("page_id = 1").count() == 1


def test_empty_table(spark):
    path = scratch_path(spark, "test-archive")
    warc.write_archive(table(spark, []), path)
    assert warc.digest_report(spark, path).collect() == []
