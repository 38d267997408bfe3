"""WARC archives: writing captures, reading records, and assembling transactions by concurrent-to identifiers."""
from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from relinker.llm.common import fresh_path, settle

# Format version, line end, end of a record, alphabet of base32.
VERSION = "WARC/1.1"
LINE_END = "\r\n"
RECORD_END = "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

SALTS = 16
NO_PAGE = -(2**63)
RECORD_SCHEMA = (
    "file string, offset bigint, record_id string, record_type string, concurrent_to array<string>, refers_to string, "
    "target_uri string, date string, fields map<string,string>, payload binary, payload_bytes bigint, payload_digest string")


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a string's UTF-8 bytes in base32: 40 bits at a time."""
    digits = F.sha1(payload.cast("binary"))
    groups = [
        F.lpad(F.conv(F.substring(digits, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record(kind: str, own: Column, uri: Column, extra: list[Column], mime: str, block: Column) -> Column:
    """A record without its end, which the text writer adds."""
    head = [
        F.lit(f"{VERSION}{LINE_END}WARC-Type: {kind}{LINE_END}WARC-Date: {DATE}{LINE_END}WARC-Record-ID: "), own,
        F.lit(f"{LINE_END}WARC-Target-URI: "), uri, *extra, F.lit(f"{LINE_END}Content-Type: {mime}{LINE_END}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(RECORD_END), block]
    return F.concat(*head)


def originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with ``original``: the response that a later reader should look at, null where the page is one itself.

    Of pages with equal payloads of at least ``least_bytes`` bytes, the one with the largest page_id (null is less
    than any; a repeated id: the last row) is the response. Only payloads that occur twice are joined, by digest and a
    salt, so that a payload of a third of all pages does not end in one task.
    """
    rows = pages.select(
        "page_id", "url", F.coalesce("html", F.lit("")).alias("payload"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumns({
        "digest": base32_sha1(F.col("payload")), "capture": F.struct(F.coalesce("page_id", F.lit(NO_PAGE)).alias("page_id"), "row"),
        "salt": F.pmod(F.xxhash64("row"), F.lit(SALTS))})
    found = (
        rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.max("capture").alias("last"), F.count("*").alias("n")).where("n > 1")
        .select("digest", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt")))
    joined = rows.join(found, ["digest", "salt"], "left")
    other = F.col("last").isNotNull() & (F.col("last.row") != F.col("row")) & (F.octet_length("payload") >= least_bytes)
    return joined.withColumn("original", F.when(other, F.col("last"))).drop("last", "salt")


def _name(capture: Column, part: str) -> Column:
    return F.concat(F.lit("<urn:capture:"), capture["page_id"].cast("string"), F.lit("."), capture["row"].cast("string"), F.lit(f":{part}>"))


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One text row per WARC record: request, response or revisit, and metadata of every page.

    A line break in a URL is written as a blank, as it would end the header.
    """
    p = originals(pages, least_bytes)
    capture, original, payload = F.col("capture"), F.col("original"), F.col("payload")
    uri = F.regexp_replace(F.coalesce("url", F.lit("urn:none")), r"[\r\n]", " ")
    concurrent = [F.lit(f"{LINE_END}WARC-Concurrent-To: "), _name(capture, "response")]
    digest = [F.lit(f"{LINE_END}WARC-Payload-Digest: sha1:"), F.col("digest")]
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE_END}Content-Type: text/html; charset=utf-8{LINE_END}Content-Length: "),
        F.octet_length(payload).cast("string"), F.lit(RECORD_END))
    response = _record("response", _name(capture, "response"), uri, digest, "application/http;msgtype=response", F.concat(http, payload))
    revisit = _record(
        "revisit", _name(capture, "response"), uri,
        [*digest, F.lit(f"{LINE_END}WARC-Profile: {PROFILE}{LINE_END}WARC-Refers-To: "), _name(original, "response")],
        "application/http;msgtype=response", http)
    request = _record(
        "request", _name(capture, "request"), uri, concurrent, "application/http;msgtype=request",
        F.concat(F.lit("GET "), uri, F.lit(f" HTTP/1.1{RECORD_END}")))
    about = F.concat(
        F.lit("page-id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(LINE_END),
        F.when(original.isNotNull(), F.concat(F.lit("refers-to-page: "), original["page_id"].cast("string"), F.lit(LINE_END))).otherwise(""))
    metadata = _record("metadata", _name(capture, "metadata"), uri, concurrent, "application/warc-fields", about)
    whole = F.array(request, F.when(original.isNull(), response).otherwise(revisit), metadata)
    return p.select(F.explode(whole).alias("value"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, records_per_file: int = 12_000) -> str:
    """Writes pages(page_id, url, html) as WARC files. Spark's text writer puts the end of a record after every row."""
    (records(pages, least_bytes).write.option("lineSep", RECORD_END).option("maxRecordsPerFile", records_per_file)
     .option("compression", "gzip").text(folder))
    return folder


def parse(file: str, data: bytes, keep_payload: bool) -> Iterator[dict]:
    """The records of one archive, by their Content-Length; bytes between records are skipped up to the next version line."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head: dict[str, list[str]] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head.setdefault(name.strip().lower(), []).append(value.strip())
        one = {k: v[0] for k, v in head.items()}
        size = int(one.get("content-length", "0"))
        block = memoryview(data)[end + 4:end + 4 + size]
        row = {
            "file": file, "offset": at, "record_id": one.get("warc-record-id"), "record_type": one.get("warc-type"),
            "concurrent_to": head.get("warc-concurrent-to", []), "refers_to": one.get("warc-refers-to"),
            "target_uri": one.get("warc-target-uri"), "date": one.get("warc-date"), "fields": {}, "payload": None,
            "payload_bytes": None, "payload_digest": one.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        if one.get("content-type", "").startswith("application/http"):
            split = bytes(block[:65536]).find(b"\r\n\r\n")
            split = bytes(block).find(b"\r\n\r\n") if split < 0 else split
            fields = bytes(block[:max(split, 0)]).decode("utf-8", "replace").split("\r\n")
            row["fields"] = {"start-line": fields[0], **dict(_field(x) for x in fields[1:])}
            payload = block[split + 4:] if split >= 0 else block[:0]
            if row["record_type"] == "response":
                row["payload_bytes"] = len(payload)
                row["payload_digest"] = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                row["payload"] = bytes(payload) if keep_payload else None
            elif row["record_type"] == "revisit":
                declared = next((v for k, v in row["fields"].items() if k.lower() == "content-length"), "")
                row["payload_bytes"] = int(declared) if declared.isdigit() else None
        elif one.get("content-type", "") == "application/warc-fields":
            row["fields"] = dict(_field(x) for x in bytes(block).decode("utf-8", "replace").split("\r\n") if x)
        yield row
        at = end + 4 + size


def _plain(data: bytes) -> bytes:
    """The content of an archive, compressed as a whole, record by record, or not at all."""
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _field(line: str) -> tuple[str, str]:
    name, _, value = line.partition(":")
    return name.strip(), value.strip()


def read_archives(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """All records of all archives below a folder, one row each. A response's digest and size are those of the bytes read."""
    columns = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"], strict=True):
                rows = []
                held = 0
                for row in parse(file, _plain(bytes(data)), keep_payload):
                    rows.append(row)
                    held += 500 + len(row["payload"] or b"")
                    if held > 8_000_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInPandas(read, RECORD_SCHEMA)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, and the structs response, request, metadata (null where missing).

    A capture is a response or revisit record; requests and metadata belong to the capture whose identifier they name as
    concurrent, or which names theirs, directly or through one other record. Identifiers are unique to a capture, so no
    join key is hot. Of several requests or metadata records of a capture the one with the smallest identifier counts; a
    record without a capture gives no row; a capture without request or metadata keeps nulls.
    """
    whole = F.struct(*[c for c in found.columns])
    main = F.col("record_type").isin("response", "revisit")
    captures = found.where(main).select(F.col("record_id").alias("capture_id"), whole.alias("response"))
    others = found.where(~main).select("record_id", "concurrent_to", whole.alias("record"))
    links = others.select("record_id", F.explode("concurrent_to").alias("other")).unionByName(
        found.where(main).select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("other")))
    # Named captures are known by their identifier alone; a link to a request or metadata record is followed once.
    ids = found.where(main).select(F.col("record_id").alias("other"), F.lit(True).alias("is_capture"))
    marked = links.join(ids, "other", "left")
    direct = marked.where("is_capture").select("record_id", F.col("other").alias("capture_id"))
    far = marked.where("is_capture is null").select("record_id", F.col("other").alias("via")).join(
        direct.select(F.col("record_id").alias("via"), "capture_id"), "via").select("record_id", "capture_id")
    owner = direct.unionByName(far).groupBy("record_id").agg(F.min("capture_id").alias("capture_id"))
    parts = others.join(owner, "record_id").groupBy("capture_id").agg(*[
        F.min_by(F.when(F.col("record.record_type") == kind, F.col("record")), F.when(F.col("record.record_type") == kind, F.col("record_id"))).alias(kind)
        for kind in ("request", "metadata")])
    return captures.join(parts, "capture_id", "left")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes archives of pages to the shared folder, reads them back and returns one row per page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to). A null html is an empty payload; a null page_id
    stays null; an empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    folder = write_archives(pages, fresh_path(spark, "warc"), least_bytes)
    # Archives are parsed once; several joins read the records.
    found = assemble(settle(read_archives(spark, folder, keep_payload=False).select(
        "record_id", "record_type", "concurrent_to", "refers_to", "fields", "payload_bytes", "payload_digest")))
    return found.select(
        F.col("metadata.fields")["page-id"].try_cast("bigint").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.nullif(F.regexp_extract("response.refers_to", r"^<urn:capture:(-?\d+)\.", 1).try_cast("bigint"), F.lit(NO_PAGE)).alias("refers_to"))
