"""WARC archives of pages with revisit resolution.

A page is its headers (page_id, url, digests and length of the payload) and its payload, the html in UTF-8. Headers are
shuffled by payload digest: of equal payloads the largest page_id is the response, the others become revisit records that
name it. Payloads travel once: copies fold into their response within each task, before the shuffle, and a revisit has
none. Payloads are equal if length, SHA-1 and SHA-256 are.

Archives are gzip text files of one folder: a record is its header block, an empty line, its content block and two line
ends, so Spark's own writer with that separator makes valid WARC/1.1 and commits it safely. Reading takes the pieces in
file order and puts records together by Content-Length. Compressed files are not split: an archive is what a task of the
shuffle by digest writes, so their size follows the session's shuffle partitions. A file is one gzip member.

Record ids are digests of page, url, payload and copy number: a task that runs again writes the same ones. A digest that more than
one in HOT_SHARE headers has is met by broadcast (there are fewer than HOT_SHARE of them) and its rows are spread.

Payloads below ``least_bytes`` are responses all of them. Null html counts as empty. Repeated rows are records of their
own, one of them the response. A null page_id is smaller than any other and stays null; a null url is written as a urn of
the page. Blanks and control characters in a url are percent-encoded. Extra columns are not read; an empty table gives
empty archives.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleloom.llm.storage import shared_path, written

LEAST_BYTES = 0
HOT_SHARE = 1000
END = "\r\n\r\n"
# Digits of numbers to base 32 and the letters that stand for them in digests, and the profile of revisits.
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = r"[\x00-\x20\x7F]"

KEY = ["bytes", "sha1", "sha256"]


def base32(hexadecimal: Column) -> Column:
    """Base32 of a SHA-1 given in hex; five hex digits are four letters."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*parts), DIGITS, LETTERS)


def headers(pages: DataFrame) -> DataFrame:
    """page_id, url, bytes, sha1, sha256 and html of every page."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    raw = F.col("html").cast("binary")
    return page.select("page_id", "url", F.octet_length("html").cast("long").alias("bytes"), F.sha1(raw).alias("sha1"), F.sha2(raw, 256).alias("sha256"), "html")


def target(url: Column, page_id: Column) -> Column:
    encoded = F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(UNSAFE), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    safe = F.when(url.rlike(UNSAFE), encoded).otherwise(url)
    return F.coalesce(F.nullif(safe, F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none"))))


def record_id(page_id: Column, url: Column, copy: Column) -> Column:
    h = F.sha2(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("none")), F.coalesce(url, F.lit("none")), "sha1", "sha256", copy.cast("string")), 256)
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def spread_join(rows: DataFrame, owners: DataFrame, on: list[str], share: int = HOT_SHARE) -> DataFrame:
    """``rows`` with the ``owner`` of their key; keys of ``owners`` (on, owner) are unique, those of rows may be hot.

    Keys with more than one in ``share`` rows, fewer than ``share`` therefore, are broadcast; their rows keep out of the
    shuffle's hot partitions by keys of their own.
    """
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = rows.count()
    hot = owners.join(sizes.filter(F.col("__n") * share > total).drop("__n"), on).withColumnRenamed("owner", "__hot")
    marked = rows.join(F.broadcast(hot), on, "left")
    # A salt of null meets nothing in the second join, a salt of 0 its owner.
    spread = F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)).cast("int"))
    found = marked.withColumn("__salt", spread).join(owners.withColumn("__salt", F.lit(0)), [*on, "__salt"], "left")
    return found.select(*rows.columns, F.coalesce("__hot", "owner").alias("owner"))


def _lines(*fields: tuple[str, Column]) -> Column:
    return F.concat_ws("\r\n", *[F.concat(F.lit(name + ": "), value) for name, value in fields])


def _http() -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))


def _record(kind: str, copy: Column, date: str, payload: Column, *more: tuple[str, Column]) -> Column:
    page, url = F.col("page_id"), F.col("url")
    block = F.concat(_http(), payload)
    head = _lines(
        ("WARC-Type", F.lit(kind)),
        ("WARC-Record-ID", record_id(page, url, copy)),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", target(url, page)),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        *more,
        ("WARC-Page-ID", page.cast("string")),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block).cast("string")),
    )
    return F.concat(F.lit("WARC/1.1\r\n"), head, F.lit(END), block).alias("value")


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str | None = None) -> None:
    """The records of all pages under ``path``: folder ``response`` with payloads, folder ``revisit`` without."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = headers(pages)
    small = F.col("bytes") < least_bytes
    # Small payloads fold only with repeated rows, larger ones with all their copies.
    alone = F.when(small, F.struct("page_id", "url")).alias("alone")
    # A null page_id is the smallest of all in a struct; the url decides between equal ids.
    page = F.struct("page_id", "url")
    folded = rows.withColumn("alone", alone).groupBy(*KEY, "alone").agg(F.max(page).alias("owner"), F.count(F.lit(1)).alias("n"), F.first("html").alias("html"))
    copies = F.when(F.col("bytes") < least_bytes, F.col("n")).otherwise(1)
    responses = folded.select(*KEY, F.col("owner.page_id").alias("page_id"), F.col("owner.url").alias("url"), "html", F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("copy"))
    _write(responses.select(_record("response", F.col("copy"), date, F.col("html"))), f"{path}/response")

    # Headers alone from here on, written once: the joins below ask for them several times.
    large = written(rows.filter(~small).drop("html").groupBy(*KEY, "page_id", "url").agg(F.count(F.lit(1)).alias("n")), "headers")
    owners = large.groupBy(*KEY).agg(F.max(page).alias("owner"), F.sum("n").alias("of")).filter("of > 1").drop("of")
    met = spread_join(large, owners, KEY)
    is_owner = F.col("owner").eqNullSafe(page)
    first = F.when(is_owner, F.lit(2)).otherwise(F.lit(1)).cast("long")
    copy = F.explode(F.filter(F.sequence(F.lit(1).cast("long"), F.col("n")), lambda c: c >= first)).alias("copy")
    revisits = met.filter("owner is not null").select(*KEY, "page_id", "url", "owner", copy)
    origin = record_id(F.col("owner.page_id"), F.col("owner.url"), F.lit(1))
    refers = [
        ("WARC-Refers-To", origin),
        ("WARC-Refers-To-Target-URI", target(F.col("owner.url"), F.col("owner.page_id"))),
        ("WARC-Refers-To-Date", F.lit(date)),
        ("WARC-Profile", F.lit(PROFILE)),
    ]
    _write(revisits.select(_record("revisit", F.col("copy"), date, F.lit(""), *refers)), f"{path}/revisit")


def _write(records: DataFrame, path: str) -> None:
    records.write.option("compression", "gzip").option("lineSep", END).text(path)


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes | None]]:
    """Named fields, content and payload (None for a revisit) of the records of archives cut at END, pieces in order.

    The archives' bytes are the pieces, each with END behind it. Contents may hold END or begin one of their own with
    their last bytes, so lengths alone decide; line ends between records are passed over.
    """
    end, rest = END.encode(), b""
    while True:
        rest = rest.lstrip(b"\r\n")
        while end not in rest:
            piece = next(pieces, None)
            if piece is None:
                if rest:
                    raise ValueError("an archive ends within a record's header")
                return
            rest = (rest + piece + end).lstrip(b"\r\n")
        head, _, rest = rest.partition(end)
        version, _, lines = head.partition(b"\r\n")
        if not version.startswith(b"WARC/1."):
            raise ValueError(f"no record begins with {version[:40]!r}")
        fields = dict(line.split(": ", 1) for line in lines.decode().split("\r\n"))
        length, held, size = int(fields["Content-Length"]), [rest], len(rest)
        while size < length:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError("an archive ends within a record")
            held += [piece, end]
            size += len(piece) + len(end)
        content = b"".join(held)
        content, rest = content[:length], content[length:]
        payload = content[content.index(end) + len(end) :]
        yield fields, content, payload if fields["WARC-Type"] == "response" else None


RECORDS = "record_id string, record_type string, page_id long, url string, date string, payload_digest string, refers_to_id string, payload_bytes long"


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records under ``path``; length and digest are those of the payload read, and a payload that belies its header is an error."""

    def run(batches):
        pieces = (x.as_py() for batch in batches for x in batch.column("value"))
        held, size = [], 0
        for fields, _, payload in parsed(pieces):
            digest = None
            if payload is not None:
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                if fields["WARC-Payload-Digest"] != "sha1:" + digest:
                    raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not the one its header names")
            held.append((fields, digest, payload))
            size += len(payload or b"") + 400
            if size > 4 << 20:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    def rows(held):
        def text(name):
            return pa.array([f.get(name) for f, _, _ in held], pa.string())

        page = [f.get("WARC-Page-ID") for f, _, _ in held]
        columns = [
            text("WARC-Record-ID"),
            text("WARC-Type"),
            pa.array([None if p is None else int(p) for p in page], pa.int64()),
            text("WARC-Target-URI"),
            text("WARC-Date"),
            pa.array([d for _, d, _ in held], pa.string()),
            text("WARC-Refers-To"),
            pa.array([None if p is None else len(p) for _, _, p in held], pa.int64()),
        ]
        names = ["record_id", "record_type", "page_id", "url", "date", "payload_digest", "refers_to_id", "payload_bytes"]
        if with_payload:
            columns.append(pa.array([p for _, _, p in held], pa.binary()))
            names.append("payload")
        return pa.record_batch(columns, names=names)

    lines = spark.read.option("lineSep", END).option("recursiveFileLookup", "true").text(path)
    return lines.select(F.col("value").cast("binary").alias("value")).mapInArrow(run, RECORDS + (", payload binary" if with_payload else ""))


def resolved(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all records; revisits have their response's payload."""
    facts = ["page_id", "payload_bytes", "payload_digest"]
    records = written(records.select("record_id", "record_type", "refers_to_id", *facts), "records")
    responses = records.filter("record_type = 'response'")
    owners = responses.select(F.col("record_id").alias("refers_to_id"), F.struct(*facts).alias("owner"))
    revisits = spread_join(records.filter("record_type = 'revisit'").select("page_id", "refers_to_id"), owners, ["refers_to_id"])
    lost = F.raise_error(F.concat(F.lit("no response has the id "), "refers_to_id"))
    size = F.when(F.col("owner").isNull(), lost.cast("long")).otherwise(F.col("owner.payload_bytes"))
    first = responses.select(*facts, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    again = revisits.select(
        "page_id", size.alias("payload_bytes"), F.col("owner.payload_digest").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("owner.page_id").alias("refers_to")
    )
    return first.union(again)


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
g AS (SELECT html, max(page_id) AS top FROM p GROUP BY 1),
d AS (
  SELECT p.page_id, p.html, g.top,
    p.page_id IS NOT DISTINCT FROM g.top AND row_number() OVER (PARTITION BY p.html, p.page_id ORDER BY p.url DESC NULLS LAST) = 1 AS original
  FROM p JOIN g ON p.html = g.html
), h AS (SELECT *, sha1(html) AS x FROM d)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, 5 * (k // 4) + 1, 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original THEN NULL ELSE top END AS refers_to
FROM h
"""


def op12(spark, sf_dir) -> DataFrame:
    path = shared_path(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return resolved(read_archives(spark, path, with_payload=False))
