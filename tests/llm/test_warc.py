import base64
import hashlib
from collections import defaultdict

import pytest

from taproom.llm import warc

SCHEMA = "page_id long, url string, html string, payload int, refers_to string"
ROWS = [
    (1, "http://a/ b", "<p>x</p>"), (2, "http://a", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"),
    (6, "u", "\n"), (7, "é/ü", "http://z 0.0.0.0 1 text/html 5\n12345\n"), (7, "é/ü", "http://z 0.0.0.0 1 text/html 5\n12345\n"),
    (None, "n", "no id"), (None, "n", "<p>x</p>"), (9, "u", "z" * 300_000), (10, "u", "z" * 300_000),
]


def brute(rows, least=0):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = []
    for html, pages in groups.items():
        data = html.encode()
        known = [p for p in pages if p is not None]
        for p in pages:
            again = len(pages) > 1 and len(data) >= least and known and p != max(known)
            digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
            out.append((p, len(data), digest, "revisit" if again else "response", max(known) if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("version", ["1", "2"])
def test_round_trip(spark, tmp_path, version):
    frame = spark.createDataFrame([(*r, 1, "x") for r in ROWS], SCHEMA).repartition(3)
    path = str(tmp_path / "archives")
    warc.write_archives(frame, path, archive_bytes=400, arc_version=version)
    got = warc.read_archives(spark, path).collect()
    mine = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr)
    assert [x[3:] for x in mine if x[0] is None] == [("response", None)] * 2
    rows = [r for r in ROWS if r[0] is not None]
    assert [x for x in mine if x[0] is not None] == brute(rows)
    assert sorted(bytes(r.payload) for r in got) == sorted((h or "").encode() for _, _, h in ROWS)
    assert len({r.record_id for r in got}) == len(got)
    assert all(r.date == "1970-01-01T00:00:00Z" for r in got)


def test_small_payloads_stay_responses(spark, tmp_path):
    frame = spark.createDataFrame([(*r, 1, "x") for r in ROWS if r[0] is not None], SCHEMA)
    path = str(tmp_path / "archives")
    warc.write_archives(frame, path, least=100)
    got = {(r.page_id, r.record_type) for r in warc.read_archives(spark, path).collect()}
    assert (1, "response") in got and (9, "revisit") in got and (10, "response") in got


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_archives(spark, path).count() == 0


def test_header_lines_of_both_versions():
    for version in ("1", "2"):
        data = warc.arc_open("x.arc", version) + warc.arc_record(version, "http://a b", "20010203040506", b"body\n\n", [("K", "v")])
        (one,) = warc.read_arc(data)
        payload, head = warc.payload_of(one["block"])
        assert payload == b"body\n\n" and head["k"] == "v" and one["URL"] == "http://a%20b"
        ((fields, block),) = warc.read_warc(warc.warc_record(one))
        assert fields["warc-date"] == "2001-02-03T04:05:06Z" and block == one["block"]
        assert fields["warc-record-id"] == warc.record_name("x.arc", one["at"])


@pytest.mark.parametrize("data", [b"no\n", b"filedesc://x 0.0.0.0 1 text/plain 5\n9 0 x\n\nbad", warc.arc_open("x") + b"u 0.0.0.0 1 t 99\nshort"])
def test_broken_archives_are_errors(data):
    with pytest.raises((ValueError, KeyError)):
        list(warc.read_arc(data))
