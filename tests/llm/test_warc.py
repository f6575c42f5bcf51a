import hashlib
import io
import zlib

import pytest

from scriptmill.llm import warc as W
from scriptmill.session import new_path

LONG = "payload " * 200


def record(i, payload=b"hello", refers=None):
    return W.encode_record(i, f"http://a/{i}", payload, hashlib.sha1(payload).hexdigest(), refers)


def read(data):
    return list(W.salvage(io.BytesIO(data)))


def ids(rows):
    return [r.get("page_id") if r["kind"] != "gap" else ("gap", r["offset"], r["gap_bytes"]) for r in rows]


def test_salvage_reads_on_after_damage():
    parts = [record(i, f"text {i} ".encode() * 50) for i in range(5)]
    assert ids(read(b"".join(parts))) == ["0", "1", "2", "3", "4"]
    for k in range(5):
        hurt = bytearray(parts[k])
        hurt[len(hurt) // 2] ^= 0xFF
        data = b"".join([*parts[:k], bytes(hurt), *parts[k + 1:]])
        begin = sum(map(len, parts[:k]))
        want = ["0", "1", "2", "3", "4"]
        want[k] = ("gap", begin, len(hurt))
        assert ids(read(data)) == want
    cut = b"".join(parts)[:-7]
    assert ids(read(cut))[:4] == ["0", "1", "2", "3"] and read(cut)[-1]["kind"] == "gap"
    assert ids(read(b"junk" + parts[0] + b"\x1f\x8b\x08junk" + parts[1])) == [
        ("gap", 0, 4), "0", ("gap", 4 + len(parts[0]), 7), "1"]
    assert read(b"") == [] and ids(read(b"x" * 200_000)) == [("gap", 0, 200_000)]


def test_salvage_of_plain_records(monkeypatch):
    parts = [zlib.decompress(record(i, f"WARC/1.0 inside {i}".encode() * 9), 31) for i in range(4)]
    assert ids(read(b"".join(parts))) == ["0", "1", "2", "3"]
    wrong = parts[1].replace(b"inside 1", b"inside 7", 1)
    rows = read(parts[0] + wrong + parts[2] + record(9) + parts[3])
    assert [r["page_id"] for r in rows if r["kind"] != "gap"] == ["0", "2", "9", "3"]
    assert sum(r["gap_bytes"] for r in rows if r["kind"] == "gap") == len(wrong)
    monkeypatch.setattr(W, "READ_BYTES", 7)
    assert ids(read(b"".join(parts))) == ["0", "1", "2", "3"]


@pytest.mark.parametrize("size", [W.ARCHIVE_BYTES, 500])
def test_round_trip(spark, size):
    pages = [(1, "http://a/1", LONG), (2, "http://a/2\r\nX: y", LONG), (3, None, "short"), (4, "u", "short"), (5, "u", None),
             (6, "u", ""), (7, "u", "é" * 100_000), (None, "u", LONG), (8, "u", LONG), (8, "u", LONG)]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, digest string, size string")
    archives = W.write_archives(W.revisits(df), new_path(spark, "test-warc"), size)
    rows = W.read_archives(archives).collect()
    assert len(rows) == len(pages) and archives.agg({"records": "sum"}).first()[0] == len(pages)
    n = len(LONG)
    by = {(r.page_id, r.kind): r for r in rows}
    assert {k: v.refers_to for k, v in by.items() if v.kind == "revisit"} == {
        ("1", "revisit"): "8", ("2", "revisit"): "8", (None, "revisit"): "8"}
    assert bytes(by["7", "response"].payload).decode() == "é" * 100_000 and by["1", "revisit"].payload_bytes == n
    assert by["2", "revisit"].url == "http://a/2%0D%0AX:%20y"
    assert by["5", "response"].payload_digest == hashlib.sha1(b"").hexdigest()


def test_no_pages(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    archives = W.write_archives(W.revisits(df), new_path(spark, "test-warc"))
    assert archives.count() == 0 and W.read_archives(archives).count() == 0


def test_no_record_is_lost_silently(spark, monkeypatch):
    df = spark.createDataFrame([(1, "u", "short"), (2, "u", "other")], "page_id long, url string, html string")
    archives = W.write_archives(W.revisits(df), new_path(spark, "test-warc"))
    assert W.read_archives(archives, whole=True).count() == 2
    with pytest.raises(Exception, match="records"):
        W.read_archives(archives.selectExpr("archive", "records + 1 as records"), whole=True).collect()
    monkeypatch.setattr(W, "RECORD_BYTES", 1000)
    with pytest.raises(ValueError, match="more than 1000"):
        record(1, b"x" * 1000)


def sizes(df):
    return [len(part) for part in df.rdd.glom().collect() if part]


def test_archives_are_spread_over_tasks(spark):
    pages = spark.range(200).selectExpr("id as page_id", "'u' as url", "concat('text ', id) as html")
    archives = W.write_archives(W.revisits(pages), new_path(spark, "test-warc"), 1)
    assert archives.count() == 200
    rows = sizes(W.read_archives(archives, with_payload=False))
    assert sum(rows) == 200 and len(rows) > 100 and max(rows) <= 8


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_one_payload_may_be_most_rows(spark, monkeypatch, broadcast):
    """A broadcast moves no page; a shuffle spreads small payloads, and repeated ones are joined the same way."""
    from scriptmill.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", broadcast)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    hot = "concat(repeat('x', 1200), case when id % 10 = 0 then cast(id % 7 as string) else '' end)"
    pages = spark.range(2000).selectExpr(
        "id as page_id", "'u' as url", f"case when id % 4 = 3 then null when id % 4 = 2 then 'small' else {hot} end as html")
    found = W.revisits(pages).drop("payload")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == bool(broadcast)
    top = {}
    rows = found.collect()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts = {r.page_id: r.html for r in pages.collect()}
    for i, text in texts.items():
        top[text] = max(top.get(text, -1), i)
    assert {r.page_id: r.refers_to for r in rows} == {
        i: top[t] if t and len(t) >= 1000 and top[t] != i else None for i, t in texts.items()}
