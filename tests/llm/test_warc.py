import base64
import hashlib
import zlib
from collections import Counter

import pytest

from lodestrand.llm import store, warc

ROWS = [
    (5, "http://a/x y", "<p>same</p>"), (2, "http://b/", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "http://c/", None), (4, "http://d/", ""), (6, "http://e/\r\nX: y", "é\r\n\r\nWARC/1.1\r\n\r\n🙂"),
    (7, "", "z" * 300_000), (8, "http://f/", "\n"), (2, "http://b/", "<p>same</p>"), (None, "http://g/", "<p>same</p>"), (None, "http://h/", "alone"),
]


def brute(rows, least):
    first = {}
    for i, _, h in rows:
        body = (h or "").encode()
        if len(body) >= least and i is not None:
            first[body] = min(i, first.get(body, i))
    out = Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        f = first.get(body)
        revisit = f is not None and f != i
        out[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", f if revisit else None] += 1
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string").selectExpr("*", "1 as payload", "2 as record_id", "'x' as payload_digest")
    got = warc.dedup_roundtrip(df, min_bytes=least)
    assert Counter((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got.collect()) == brute(ROWS, least)


def test_archives_are_warc(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), records_per_file=4)
    files = sorted((tmp_path / "w").glob("*.gz"))
    assert len(files) >= 3
    seen = []
    for f in files:
        data = zlib.decompress(f.read_bytes(), 31)
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            n = int(fields["Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n"
            seen.append((fields, rest[:n]))
            data = rest[n + 4 :]
    assert len(seen) == len(ROWS)
    for fields, block in seen:
        body = block.partition(b"\r\n\r\n")[2]
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
        else:
            assert body == b"" and "WARC-Refers-To" in fields and fields["WARC-Profile"] == warc.PROFILE
    full = [r for r in warc.read_archives(spark, str(tmp_path / "w")).collect() if r["record_type"] == "response"]
    assert {r["payload"] for r in full} == {h or "" for _, _, h in ROWS}


def test_large_payloads_and_the_salted_way(spark, monkeypatch, tmp_path):
    rows = [(i, f"http://x/{i}", "big" * 20_000_000 if i == 7 else f"p{i % 5}" * 50_000) for i in range(12)] + [(i, None, "hot") for i in range(20, 60)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    want = brute(rows, 0)
    collect = lambda: Counter((r["record_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.dedup_roundtrip(df).collect())
    assert collect() == want
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    assert collect() == want
    warc.write_archives(df, str(tmp_path / "w"))
    assert max(len(zlib.decompress(f.read_bytes(), 31)) for f in (tmp_path / "w").glob("*.gz") if f.stat().st_size < 40_000) < 2 << 20


def test_damage_is_found(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "http://a/", "payload one")], "page_id bigint, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 1
    [data] = filter(None, (gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*.gz")))
    damaged = gzip.compress(data.replace(b"payload one", b"payload 0ne"))
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.gz").write_bytes(damaged)
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.read_archives(spark, str(tmp_path / "d")).collect()
    with pytest.raises(TypeError):
        warc.write_archives(df.selectExpr("cast(page_id as string) as page_id", "url", "html"), str(tmp_path / "x"))


def test_payloads_stay_out_of_the_shuffle(spark):
    """The payload meets the table of revisits by broadcast while that is small."""
    df = spark.createDataFrame(ROWS, "page_id bigint, url string, html string")
    base = warc._base(df, "page_id", "url", "html")
    revisits = warc.resolve(base.select("record_id", "payload_digest", "payload_bytes"))
    plan = warc.records(base, revisits, "2025-01-01T00:00:00Z")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_reader_follows_lengths():
    record = b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\ncde\r\n\r\n"
    for step in (1, 3, 7, 1000):
        chunks = (record * 3)[0:0], *((record * 3)[i : i + step] for i in range(0, 3 * len(record), step))
        assert [b for _, b in warc.RecordReader(iter(chunks))] == [b"ab\r\n\r\ncde"] * 3
    for bad in (record[:-2], record[:20], b"nonsense\r\n\r\n"):
        with pytest.raises((ValueError, KeyError)):
            list(warc.RecordReader(iter([bad])))
    packed = zlib.compressobj(wbits=31)
    member = packed.compress(record) + packed.flush()
    assert b"".join(warc.inflate(member * 2, 5)) == record * 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.dedup_roundtrip(df).count() == 0


def test_shared_folder_is_the_sessions(spark):
    assert store.shared_dir(spark) == store.shared_dir(spark)
    assert store.table_path(spark, "x").startswith(store.shared_dir(spark))
