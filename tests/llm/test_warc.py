import base64
import gzip
import hashlib
import random
from collections import defaultdict
from pathlib import Path

import pytest

from ruleloom.llm.storage import shared_path
from ruleloom.llm.warc import END, parsed, read_archives, resolved, spread_join, write_archives

SCHEMA = "page_id long, url string, html string"


def plain(rows, least=0):
    groups = defaultdict(list)
    for i, (page, url, html) in enumerate(rows):
        groups[html or ""].append((page is not None, page or 0, url is not None, url or "", -i))
    out = []
    for html, members in groups.items():
        raw = html.encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        members.sort(reverse=True)
        for k, (known, page, *_) in enumerate(members):
            first = k == 0 or len(raw) < least
            top = members[0][1] if members[0][0] else None
            out.append((page if known else None, len(raw), digest, "response" if first else "revisit", None if first else top))
    return sorted(out, key=repr)


def run(spark, rows, parts=3, extra=(), **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts).selectExpr("*", *extra)
    path = shared_path(spark, "archives")
    write_archives(df, path, **kw)
    return path, read_archives(spark, path)


def pages(n, seed):
    r = random.Random(seed)
    bodies = ["", None, "\r\n", "\r\n\r\n", "\r\n\r\n\r\n", "a\r\n\r\nWARC/1.1\r\n\r\nb", "<p>Été 中</p>\r\n", "\n\r\n", "x\r"]
    bodies += ["".join(r.choice("\r\nab") for _ in range(r.randint(0, 14))) for _ in range(n // 2)]
    return [(r.randrange(n), f"http://h/{r.randrange(5)}", r.choice(bodies)) for _ in range(n)]


@pytest.mark.parametrize("seed, least", [(1, 0), (2, 5)])
def test_equals_plain_groups(spark, seed, least):
    rows = pages(300, seed)
    path, records = run(spark, rows, least_bytes=least)
    assert sorted(map(tuple, resolved(records).collect()), key=repr) == plain(rows, least)
    ids = [r.record_id for r in records.select("record_id").collect()]
    assert len(set(ids)) == len(ids) == len(rows)


def test_payloads_come_back_whole(spark):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(["\r\n" * k + "x" * (k % 3) for k in range(60)] + ["中" * 500_000])]
    _, records = run(spark, rows)
    assert {r.page_id: bytes(r.payload).decode() for r in records.collect()} == {p: h for p, _, h in rows}


def test_files_are_archives(spark):
    """Read by a plain parser of lengths, whatever Spark makes of lines."""
    path, _ = run(spark, [(1, "http://a b\r\nX: y", "one"), (2, None, "one"), (3, "http://c", "two\r\n")], date="2024-01-02T03:04:05Z")
    found = []
    for file in Path(path.removeprefix("file:")).rglob("*.gz"):
        raw = gzip.decompress(file.read_bytes())
        while raw:
            head, _, rest = raw.partition(END.encode())
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert rest[size : size + 4] == b"\r\n\r\n"
            raw = rest[size + 4 :]
            found.append((fields, rest[:size]))
    by_page = {f["WARC-Page-ID"]: (f, c) for f, c in found}
    assert {k: f["WARC-Type"] for k, (f, _) in by_page.items()} == {"1": "revisit", "2": "response", "3": "response"}
    one = by_page["1"][0]
    assert one["WARC-Target-URI"] == "http://a%20b%0D%0AX:%20y" and one["WARC-Refers-To"] == by_page["2"][0]["WARC-Record-ID"]
    assert one["WARC-Refers-To-Target-URI"] == by_page["2"][0]["WARC-Target-URI"] == "urn:page:2" and one["WARC-Date"] == "2024-01-02T03:04:05Z"
    assert one["WARC-Payload-Digest"] == by_page["2"][0]["WARC-Payload-Digest"] and by_page["3"][1].endswith(b"two\r\n")


def test_odd_tables(spark):
    rows = [(None, None, None), (None, "u", ""), (5, "u", "h"), (5, "u", "h"), (5, "v", "h"), (6, "", "x" * 300_000), (-7, "u", "h")]
    _, records = run(spark, rows, extra=("1 AS bytes", "'c' AS owner", "2 AS n", "'q' AS sha1", "3 AS record_type"))
    assert sorted(map(tuple, resolved(records).collect()), key=repr) == plain(rows)
    _, none = run(spark, [])
    assert resolved(none).collect() == []


def test_one_payload_in_a_third_of_the_pages(spark):
    rows = [(i, "u", "same" if i % 3 == 0 else f"p{i}") for i in range(3000)]
    _, records = run(spark, rows, parts=8)
    out = resolved(records)
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows)
    hot = spark.range(3000).selectExpr("IF(id % 3 = 0, -1, id) AS k", "id")
    owners = spark.range(-1, 3000).selectExpr("id AS k", "id * 2 AS owner")
    met = spread_join(hot, owners, ["k"], share=100)
    assert met.filter("owner <> k * 2 OR owner IS NULL").count() == 0 and met.count() == 3000


@pytest.mark.parametrize("pieces", [[b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 9", b"ab"], [b"WARC/1.1"], [b"HTTP/1.1 200"]])
def test_broken_archives_are_errors(pieces):
    with pytest.raises((ValueError, KeyError)):
        list(parsed(iter(pieces)))
