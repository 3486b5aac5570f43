"""Archives whose payloads aren't text, and records of other types, survive reading and writing."""

import gzip
import hashlib

from pyspark.sql import functions as F

from fanloom.llm import lines, warc


def record(kind: str, ident: str, block: bytes, more: str = "") -> bytes:
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{ident}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\n{more}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_bytes_and_other_records(spark, tmp_path):
    payload = bytes(range(256)) * 3
    digest = "WARC-Payload-Digest: sha1:" + hashlib.sha1(payload).hexdigest() + "\r\n"
    info = b"software: x\r\n\r\nafter"
    data = record("warcinfo", "urn:i", info, "Content-Type: application/warc-fields\r\n") + record("response", "urn:a", b"HTTP/1.1 200 OK\r\n\r\n" + payload, digest)
    data += record("revisit", "urn:b", b"HTTP/1.1 200 OK\r\n\r\n", digest) + record("metadata", "urn:m", b"")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.warc.gz").write_bytes(gzip.compress(data))
    records = warc.read_archives(spark, str(tmp_path / "in"))
    assert {r[0]: r[1] for r in records.select("record_id", "warc_type").collect()} == {"urn:i": "warcinfo", "urn:a": "response", "urn:b": "revisit", "urn:m": "metadata"}
    assert records.where("payload_digest = concat('sha1:', sha1(cast(payload as binary)))").count() == 1
    resolved = warc.resolve(records)
    assert {r.record_id: r.status for r in resolved.collect()} == {"urn:i": "kept", "urn:a": "original", "urn:b": "revisit", "urn:m": "kept"}
    out = str(tmp_path / "out")
    warc.write_archives(warc.with_records(records, resolved), out, 1)
    found = {}
    for f in (tmp_path / "out").glob("*.gz"):
        found |= {h["warc-record-id"]: (h, b) for h, b in warc.parse(gzip.decompress(f.read_bytes()))}
    assert found["<urn:i>"][1] == info and found["<urn:i>"][0]["content-type"] == "application/warc-fields"
    assert found["<urn:a>"][1].split(b"\r\n\r\n", 1)[1] == payload and found["<urn:m>"][1] == b""
    assert found["<urn:b>"][0]["warc-refers-to"] == "<urn:a>"
    assert {r.record_id: r.content_length for r in resolved.collect()} == {k[1:-1]: len(b) for k, (_, b) in found.items()}
    again = warc.resolve(warc.read_archives(spark, out))
    assert {tuple(r) for r in again.drop("content_length").collect()} == {tuple(r) for r in resolved.drop("content_length").collect()}


def test_tie_of_copies_doesnt_depend_on_partitions(spark):
    df = spark.range(40).select(F.lit(1).alias("doc_id"), F.lit("one\ntwo").alias("text"), F.col("id").alias("extra"))
    whole = {tuple(r[0] for r in lines.dedup_lines(df.repartition(n)).where("text != ''").select("extra").collect()) for n in (1, 3, 7)}
    assert len(whole) == 1 and len(whole.pop()) == 1
