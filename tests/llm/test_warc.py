"""WARC archives: round trip, framing, verification, revisits."""

import hashlib
import io

import pytest

from shopmetrics.llm import warc
from tests.llm.data import with_clashes


def test_record_round_trip():
    payload = "héllo \r\n\r\n WARC/1.1".encode() * 50
    got = warc.read_record(warc.record(7, "http://a.example/ü?q=1 2", payload))
    assert (got["page_id"], got["record_type"], got["payload"]) == ("7", "response", payload)
    assert got["payload_digest"] == hashlib.sha1(payload).hexdigest() and got["url"] == "http://a.example/%C3%BC?q=1%202"
    back = warc.read_record(warc.record(None, None, payload, refers_to=9))
    assert (back["page_id"], back["url"], back["record_type"], back["refers_to"]) == (None, None, "revisit", "9")
    assert back["payload"] is None and back["payload_bytes"] == len(payload)


def test_members_are_read_incrementally(monkeypatch):
    parts = [b"a" * 100_000, b"", b"xyz"]
    archive = b"".join(map(warc.gzip_member, parts))
    for chunk in (1, 7, 1 << 18):
        monkeypatch.setattr(warc, "CHUNK", chunk)
        assert list(warc.members(io.BytesIO(archive))) == parts
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(archive[:-30])))


def test_damage_is_noticed():
    raw = warc.record(1, "u", b"payload")
    for bad in (raw.replace(b"payload", b"paYload"), raw[:-4], raw + b"x", b"nothing"):
        with pytest.raises(warc.WarcError):
            warc.read_record(bad)


def test_archives_and_revisits(spark):
    big = "<p>" + "x" * 2000
    rows = [(1, "u1", big), (2, "u2", big), (9, "u9", big), (9, "u9", big), (None, "n", big), (3, None, "short"),
            (4, "u4", "short"), (5, "u5", None), (6, "u6", ""), (7, "u7", "é" * 300_000)]
    df = with_clashes(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING"))
    got = warc.archive_and_read(df).collect()
    assert len(got) == len(rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == sorted([("1", "revisit", 9, 2003), ("2", "revisit", 9, 2003), ("9", "response", None, 2003),
                            ("9", "response", None, 2003), ("None", "revisit", 9, 2003), ("3", "response", None, 5),
                            ("4", "response", None, 5), ("5", "response", None, 0), ("6", "response", None, 0),
                            ("7", "response", None, 600_000)])
    by_id = {r["page_id"]: r for r in got}
    assert bytes(by_id[7]["payload"]).decode() == "é" * 300_000 and by_id[1]["payload"] is None
    assert by_id[1]["payload_digest"] == hashlib.sha1(big.encode()).hexdigest()
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_archives_roll_over(spark, tmp_path):
    df = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "CAST(repeat(CAST(id AS STRING), 500) AS BINARY) AS payload",
                                    "CAST(NULL AS BIGINT) AS refers_to").coalesce(1)
    folder = f"file://{tmp_path}"
    manifest = warc.write_archives(df, folder, archive_bytes=2000)
    assert manifest.count() > 3
    assert warc.read_archives(manifest, folder).count() == 50
