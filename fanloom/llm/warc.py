"""WARC archives: reading, resolution of revisit records, and writing of deduplicated archives.

Headers alone are shuffled by payload digest. The first response (by date, then record id) that holds a payload is its
original. Revisit records are joined to the original of their digest, later responses with the same payload become
revisit records of it, and a revisit record whose payload isn't there stays, marked ``unresolved``. Records of other types (warcinfo, request,
metadata, resource, conversion, continuation) are kept as they are, their whole block being the payload. Every record is
written with fresh headers: a record id of its own content, lengths and digests of what is written, and for revisits
the id, address and date of the original.

Archives are written through Spark's text sink (one gzip member a file, records ended by two line feeds with carriage
returns), so that files of lost or repeated tasks are never seen. Digests are hexadecimal.

Defined cases
    null html: an empty payload. Null url: no address header. Null page id: a page like any other. Repeated rows (same
    id, address and payload): one capture. Ties of date: the lower record id is the original. Very long payloads:
    whole. Payloads that aren't UTF-8 keep their bytes: in Spark they are strings of those bytes. Empty table: no
    records. Line breaks in an address are escaped. Further columns: ignored, but for ``content_type``, which records
    of other types keep. A broken record in an archive raises.
"""

from __future__ import annotations

import gzip

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.session import materialise, new_path

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, payload string"


_HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "
_BARE = f"HTTP/1.1 200 OK{CRLF * 2}"


def _uuid(key: Column) -> Column:
    h = F.md5(key)
    return F.concat(F.lit("urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ""))])


def captures(pages: DataFrame, recrawl: int = 2) -> DataFrame:
    """Records of a crawl of ``pages`` and of a second crawl, a day later, of every ``recrawl``-th page: a response for
    each page (date by page id), then a revisit record, which has the payload's digest and no payload."""
    page = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(-1)).alias("n"),
        F.regexp_replace(F.col("url").cast("string"), "[\\r\\n]", "%0A").alias("target_uri"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"),
    ).withColumn("payload_digest", F.concat(F.lit("sha1:"), F.sha1("payload")))
    # one scan gives both records of a page
    times = F.when(F.pmod("n", F.lit(recrawl)) == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    each = page.withColumn("again", F.explode(times))
    date = F.date_format(F.timestamp_seconds(F.lit(1_700_000_000) + F.col("n") + 86_400 * F.col("again")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = F.concat_ws("|", "n", F.coalesce("target_uri", F.lit("")), "payload_digest", F.col("again").cast("string"))
    return each.select(
        _uuid(key).alias("record_id"),
        F.when(F.col("again") == 0, "response").otherwise("revisit").alias("warc_type"),
        "target_uri",
        date.alias("warc_date"),
        "payload_digest",
        F.when(F.col("again") == 0, F.col("payload")).alias("payload"),
    )


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, warc_type, target_uri, warc_date, payload_digest, refers_to, refers_to_uri, refers_to_date, status,
    content_length): what becomes of each record, once. Payloads aren't shuffled here, only their lengths."""
    heads = records.select("record_id", "warc_type", "warc_date", "payload_digest", "target_uri", F.octet_length("payload").alias("size")).dropDuplicates(["record_id"])
    first = heads.where("warc_type = 'response'").groupBy("payload_digest").agg(F.min(F.struct("warc_date", "record_id", "target_uri")).alias("o"))
    other = ~F.col("warc_type").isin("response", "revisit")
    fate = F.when(other, "kept").when(F.col("o").isNull(), "unresolved").when(F.col("record_id") == F.col("o.record_id"), "original").when(F.col("warc_type") == "revisit", "revisit").otherwise("deduplicated")
    known = heads.join(first, "payload_digest", "left").withColumn("status", fate)
    original = F.col("status") == "original"
    kept = F.col("status") == "kept"
    refers = ~F.col("status").isin("original", "unresolved", "kept")
    head = len(_HTTP) + F.length(F.col("size").cast("string")) + 4
    return known.select(
        "record_id",
        F.when(kept, F.col("warc_type")).when(original, "response").otherwise("revisit").alias("warc_type"),
        "target_uri",
        "warc_date",
        "payload_digest",
        F.when(refers, F.col("o.record_id")).alias("refers_to"),
        F.when(refers, F.col("o.target_uri")).alias("refers_to_uri"),
        F.when(refers, F.col("o.warc_date")).alias("refers_to_date"),
        "status",
        F.when(kept, F.coalesce("size", F.lit(0))).when(original, head + F.col("size")).otherwise(len(_BARE)).cast("long").alias("content_length"),
    )


def with_records(records: DataFrame, resolved: DataFrame) -> DataFrame:
    """``resolved`` with ``record``, the text of each record as it is written."""
    kind = F.col("content_type") if "content_type" in records.columns else F.lit(None).cast("string")
    payload = records.select("record_id", "payload", kind.alias("content_type")).dropDuplicates(["record_id"])
    whole = payload.join(resolved.hint("merge"), "record_id")
    block = F.when(F.col("status") == "original", F.concat(F.lit(_HTTP), F.octet_length("payload").cast("string"), F.lit(CRLF * 2), F.col("payload"))).when(F.col("status") == "kept", F.coalesce("payload", F.lit(""))).otherwise(F.lit(_BARE))
    whole = whole.withColumn("block", block)

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("warc_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        line("WARC-Date", F.col("warc_date")),
        line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Payload-Digest", F.col("payload_digest")),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1("block"))),
        line("WARC-Profile", F.when(F.col("warc_type") == "revisit", F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to", F.lit(">"))),
        line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        line("WARC-Refers-To-Date", F.col("refers_to_date")),
        line("Content-Type", F.when(F.col("status") == "kept", F.col("content_type")).otherwise("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    return whole.withColumn("record", F.concat(header, F.lit(CRLF), "block")).drop("block", "payload", "content_type")


def write_archives(resolved: DataFrame, path: str, files: int | None = None) -> None:
    """Writes ``record`` of every row to gzipped WARC files in ``path``, each file in the order of dates and ids."""
    rows = resolved if files is None else resolved.repartition(files, "record_id")
    rows = rows.sortWithinPartitions("warc_date", "record_id")
    rows.select("record").write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parse(data: bytes):
    """(headers, block) of the records of an archive's bytes; headers are in lower case; a broken record raises."""
    at, n = 0, len(data)
    while at < n:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= n:
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].split(b"\r\n")[1:]
        head = {k.strip().lower().decode(): v.strip().decode() for k, v in (x.split(b":", 1) for x in lines)}
        size = int(head["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            raise ValueError(f"the WARC record at byte {at} is cut off")
        yield head, block
        at = end + 4 + size


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records (as ``captures`` gives them, with ``content_type``) of the plain or gzipped WARC files in ``path``.

    A task holds an Arrow batch of files (Spark ends a batch at 64 MB, so large files come alone; a file may have 2 GB
    at most) and one unpacked file, whose records it hands on in groups of about 16 MB."""
    names = ["record_id", "warc_type", "target_uri", "warc_date", "payload_digest", "payload", "content_type"]
    types = [pa.string()] * 5 + [pa.binary(), pa.string()]

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, types)], names=names)

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                data = data.as_py()
                rows, held = [], 0
                for head, block in parse(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
                    kind = head["warc-type"]
                    payload = None if kind == "revisit" else block.split(b"\r\n\r\n", 1)[-1] if kind == "response" else block
                    rows.append((head["warc-record-id"].strip("<>"), kind, head.get("warc-target-uri"), head.get("warc-date"), head.get("warc-payload-digest"), payload, head.get("content-type")))
                    held += len(block)
                    if held > 1 << 24:
                        yield made(rows)
                        rows, held = [], 0
                yield made(rows)

    schema = SCHEMA.replace("payload string", "payload binary") + ", content_type string"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema).withColumn("payload", F.col("payload").cast("string"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the deduplicated archives of all pages to the shared folder and returns their records (without text)."""
    records = captures(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    resolved = materialise(resolve(records), "resolved")
    write_archives(with_records(records, resolved), new_path(spark, "archives"))
    return resolved


OP8_SQL = """
with pages1 as (
    select coalesce(page_id, -1) as n, regexp_replace(url, '[\\r\\n]', '%0A', 'g') as uri, coalesce(html, '') as payload, 'sha1:' || sha1(coalesce(html, '')) as digest from pages
), records as (
    select *, md5(concat_ws('|', n, coalesce(uri, ''), digest, again)) as h,
        strftime(timestamp '2023-11-14 22:13:20' + to_seconds(n + 86400 * again), '%Y-%m-%dT%H:%M:%SZ') as warc_date
    from pages1, (values (0), (1)) t(again) where again = 0 or n % 2 = 0
), named as (
    select distinct *, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] as record_id from records
), firsts as (
    select *, row_number() over (partition by digest order by warc_date, record_id) as rn from named where again = 0
)
select r.record_id, case when f.record_id = r.record_id then 'response' else 'revisit' end as warc_type, r.uri as target_uri, r.warc_date, r.digest as payload_digest,
    case when f.record_id <> r.record_id then f.record_id end as refers_to,
    case when f.record_id <> r.record_id then f.uri end as refers_to_uri,
    case when f.record_id <> r.record_id then f.warc_date end as refers_to_date,
    case when f.record_id = r.record_id then 'original' when r.again = 1 then 'revisit' else 'deduplicated' end as status,
    cast(case when f.record_id = r.record_id then strlen(r.payload) + len('HTTP/1.1 200 OK') + 2 + len('Content-Type: text/html; charset=utf-8') + 2 + len('Content-Length: ') + len(strlen(r.payload)::varchar) + 4
        else len('HTTP/1.1 200 OK') + 4 end as bigint) as content_length
from named r join firsts f on f.digest = r.digest and f.rn = 1
"""
