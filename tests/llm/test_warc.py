import base64
import hashlib
import io

import pytest

from ratingloom.llm import warc
from ratingloom.session import scratch_path

SCHEMA = "page_id bigint, url string, html string, record_type string"


def pages(spark):
    rows = [
        (1, "http://a/1", "<p>x</p>", None), (2, None, "<p>x</p>", "z"), (3, "u\r\nX: y", None, None),
        (4, "http://a/4", "", None), (5, "http://a/5", "été" * 200_000, None), (5, "http://a/5", "été" * 200_000, None),
        (None, "http://a/6", "alone", None), (None, "http://a/7", "<p>x</p>", None), (9, "http://ü/", "a\r\n\r\nb", None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_odd_pages_round_trip(spark):
    got = sorted(warc.round_trip(pages(spark)).fillna(-1).drop("url").collect())
    want = []
    for r in pages(spark).fillna(-1, ["page_id"]).collect():
        same = {"<p>x</p>": 2, "": 4, None: 4}.get(r.html, r.page_id)
        refers = -1 if r.page_id >= same else same
        kind = "response" if refers == -1 else "revisit"
        want.append((r.page_id, len((r.html or "").encode()), digest(r.html), kind, refers))
    assert [tuple(r) for r in got] == sorted(want)


def test_payloads_come_back_and_revisits_carry_none(spark):
    manifest = warc.write(pages(spark), scratch_path(spark, "warc-test"))
    rows = warc.read(spark, manifest).collect()
    assert {r.payload for r in rows if r.record_type == "response" and r.page_id == 9} == {b"a\r\n\r\nb"}
    assert {r.payload for r in rows if r.record_type == "revisit"} == {None}


def test_no_pages_no_records(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_are_cut_one_by_one_in_small_steps(monkeypatch):
    monkeypatch.setattr(warc, "STEP", 7)
    records = [warc.record([("WARC-Type", "metadata")], bytes([65 + i]) * i * 50) for i in range(5)]
    blocks = [warc.parse(m)[1] for m in warc.members(io.BytesIO(b"".join(records)))]
    assert blocks == [bytes([65 + i]) * i * 50 for i in range(5)]
    with pytest.raises(ValueError, match="inside a gzip member"):
        list(warc.members(io.BytesIO(b"".join(records)[:-3])))


def test_damage_is_found():
    member = next(warc.members(io.BytesIO(warc.page_record(1, "u", b"hello", digest("hello"), None))))
    headers, block = warc.parse(member)
    assert warc.payload_of(headers, block) == b"hello"
    with pytest.raises(ValueError, match="digest"):
        warc.parse(member.replace(b"hello", b"hellO"))
    with pytest.raises(ValueError, match="frame"):
        warc.parse(member.replace(b"Content-Length: 6", b"Content-Length: 5"))
    with pytest.raises(ValueError, match="payload"):
        warc.payload_of(headers, block.replace(b"hello", b"jello"))
