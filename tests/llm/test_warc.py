import base64
import hashlib

from framewise.llm.common import shared_path
from framewise.llm.warc import mark_revisits, read_archives, round_trip, write_archives


def make_pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, digest string")


ROWS = [(3, "http://a/x y", "<p>same</p>"), (1, "http://a/1", "<p>same</p>"), (2, None, None), (4, "http://b", ""), (5, "u\r\nWARC/1.1", "é\r\n\r\n\U0001f600" * 9),
        (6, "http://c", "x" * 3_000_000), (7, "http://a/7", "<p>same</p>"), (1, "http://a/1", "<p>same</p>")]


def test_round_trip(spark):
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                 for r in round_trip(make_pages(spark, ROWS)).collect())
    first, exp = {}, []
    for i, _, h in ROWS:
        first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in ROWS:
        p = (h or "").encode()
        f = first[h or ""]
        exp.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if i == f else "revisit", None if i == f else f))
    assert [x[:4] for x in got] == [x[:4] for x in sorted(exp, key=lambda x: x[:4])]
    assert {x[0]: x[4] for x in got} == {x[0]: x[4] for x in exp}
    assert round_trip(make_pages(spark, [])).count() == 0


def test_smaller_payloads_never_refer(spark):
    got = {r["page_id"]: r["record_type"] for r in round_trip(make_pages(spark, ROWS), min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response", 5: "response", 6: "response", 7: "revisit"}


def test_selected_records_come_back_whole(spark):
    uri = shared_path(spark, "warc-test")
    index = write_archives(mark_revisits(make_pages(spark, ROWS)), uri, max_bytes=200)
    got = {r["page_id"]: r for r in read_archives(index.where("page_id in (5, 6)"), uri, gap=0).collect()}
    assert bytes(got[5]["payload"]) == ROWS[4][2].encode() and got[5]["url"] == "u%0D%0AWARC/1.1"
    assert len(got[6]["payload"]) == 3_000_000
    assert index.select("archive").distinct().count() >= 2
