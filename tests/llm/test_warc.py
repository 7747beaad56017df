import hashlib

import duckdb
import pytest

from varistack.llm import warc


def brute(rows):
    groups = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p in groups[data] if p is not None), default=None)
        again = len(data) >= 1000 and page is not None and page < top
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def pages():
    big, odd = "é\r\n\r\nWARC/1.1\n" * 120, "\nfiledesc://x 0 0 0 5\n" * 60
    return [(1, "http://a b/é?x", big), (9, "http://b", big), (5, None, big), (2, "http://c\nd", "x" * 999), (3, "u", "x" * 999), (4, "u", None), (6, "", ""), (7, "u", odd), (7, "u", odd), (8, "u", "y" * 1000), (None, "u", big), (11, "filedesc://x.arc y", big), (12, "filedesc://x", ""), (10, "u", "y" * 1000)]


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_round_trip_matches_brute_force(spark, tmp_path, monkeypatch, broadcast_rows):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast_rows)
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").selectExpr("*", "1 as id", "2 as digest")
    got = warc.archive(df.repartition(3), str(tmp_path / "w"))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()), key=str) == brute(pages())
    assert {r.url for r in got.where("page_id = 1").collect()} == {"http://a b/é?x"}
    assert {r.date for r in got.collect()} == {"2024-01-01T00:00:00Z"}


def test_small_blocks_and_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_BYTES", 2000)
    rows = [r for r in pages() if r[0] is not None][:9] + [(20, "u", "z" * 5000), (21, "u", "z" * 5000)]
    rows = list({r[0]: r for r in rows}.values())
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in warc.op9_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(con.execute(warc.ORACLE).fetchall(), key=str)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    records = [(b"http://x/a b", "text/html", b"abc\n\n"), (b"-", "text/html", b""), (b"u", "text/html", b"filedesc://n\n"), (b"filedesc://p", "text/html", b"x y\n")]
    data = warc.arc_file(records, version, "n.arc")
    assert [(r["url"], r["type"], r["block"]) for r in warc.read_arc(data)] == records
    with pytest.raises(ValueError):
        list(warc.read_arc(data[:-3]))


def test_digests_are_verified():
    record = warc.convert({"url": b"u", "date": "2024", "block": warc.http_block(b"abc", 1)}, None)
    assert [f["WARC-Type"] for f, _ in warc.read_warc(record)] == ["response"]
    with pytest.raises(ValueError):
        list(warc.read_warc(record.replace(b"abc", b"abd")))


def test_empty_table(spark, tmp_path):
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e")).count() == 0
