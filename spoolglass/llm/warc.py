"""Operator 10: WARC archives, and transactions assembled from them.

Each page is written as one transaction: a request, a response (or a revisit
of an earlier equal payload) and a metadata record, the first and last naming
the response's record in WARC-Concurrent-To.  Reading parses the archives into
one row per record and joins the records of a transaction by that identifier
into one nested row per capture.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoolglass.llm.common import as_batch, cut_lineage, fresh_path, pieces

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
#: Packed bytes after which an archive is closed: a file is little more than this, or one record.
ARCHIVE_BYTES = 16 << 20
FIELDS = ("record_id", "warc_type", "concurrent_to", "target_uri", "refers_to", "page_id", "payload_bytes", "payload_digest")
SCHEMA = pa.schema([(n, pa.int64() if n in ("page_id", "payload_bytes") else pa.string()) for n in FIELDS])
DDL = ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'string'}" for f in SCHEMA)


def record_urn(kind: str, page_id: int | None, url: str | None, digest: str, nth: int) -> str:
    """The same identifier whenever a task is run again."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{kind}|{page_id}|{url}|{digest}|{nth}')}>"


def header_value(text: str) -> str:
    """A URI without characters that would end or split a header line; all others stay."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def record(kind: str, urn: str, fields: list[tuple[str, str]], block: str, content_type: str) -> str:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", f"WARC-Date: {DATE}", *(f"{k}: {v}" for k, v in fields)]
    return "\r\n".join([*lines, f"Content-Type: {content_type}", f"Content-Length: {len(block.encode())}"]) + END + block


def transaction(page_id: int | None, url: str | None, payload: str, digest: str, nth: int, first: tuple | None) -> tuple[str, str, str]:
    """The three records of a page; ``first`` has page_id, url and number of the response that a revisit refers to."""
    urn = record_urn("response", page_id, url, digest, nth)
    target = [("WARC-Target-URI", header_value(url))] if url is not None else []
    path = re.sub(r"^[a-z]+://[^/]*", "", header_value(url or "")) or "/"
    request = record("request", record_urn("request", page_id, url, digest, nth), [*target, ("WARC-Concurrent-To", urn)], f"GET {path} HTTP/1.1{END}", "application/http;msgtype=request")
    size = len(payload.encode())
    answer = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"
    own = [*target, ("WARC-Payload-Digest", f"sha1:{digest}")]
    if first is None:
        main = record("response", urn, own, answer + payload, "application/http;msgtype=response")
    else:
        own += [("WARC-Refers-To", record_urn("response", *first[:2], digest, first[2])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        main = record("revisit", urn, own, answer, "application/http;msgtype=response")
    facts = "" if page_id is None else f"page-id: {page_id}\r\n"
    meta = record("metadata", record_urn("metadata", page_id, url, digest, nth), [*target, ("WARC-Concurrent-To", urn)], facts, "application/warc-fields")
    return request, main, meta


def base32_sha1(payload: str) -> str:
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def write_archives(pages: DataFrame, path: str, *, min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write one transaction for each row of ``pages`` to archives under ``path``.

    Each record is a gzip member of its own, so that a reader can start at any
    of them; a file holds about ``ARCHIVE_BYTES`` and ends with a zero byte of
    padding.  A task that is run again writes the same bytes.
    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with
    the smallest id (rows without an id last, then by URL) is the response, the
    others are revisits.  Null html is an empty payload; a null URL gives
    records without a target; repeated rows are transactions of their own.
    """
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha1(F.col("payload").cast("binary"))).withColumn("key", F.xxhash64("page_id", "url"))
    # The order of rows with equal payloads: by id, then URL; equal ones are numbered where they are written.
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("no_url"), "url")
    slim = rows.filter(F.octet_length("payload") >= min_revisit_bytes).select("sha", "key", rank.alias("rank"))
    groups = slim.groupBy("sha").agg(F.min("rank").alias("first"), F.count("*").alias("size")).filter("size > 1")
    firsts = slim.groupBy("sha", "key").agg(F.min("rank").alias("rank")).join(groups, "sha")
    firsts = firsts.select("sha", "key", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url"), F.col("rank").eqNullSafe(F.col("first")).alias("is_first"))
    ready = rows.repartition(n, "sha", "key").join(firsts, ["sha", "key"], "left").sortWithinPartitions("sha", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, nth, members, size = None, 0, [], 0
        for batch in pieces(batches, "payload"):
            for r in batch.to_pylist():
                here = (r["page_id"], r["url"], r["sha"])
                nth = nth + 1 if here == last else 0
                last = here
                digest = base64.b32encode(bytes.fromhex(r["sha"])).decode()
                answer = r["is_first"] is None or (r["is_first"] and nth == 0)
                for text in transaction(r["page_id"], r["url"], r["payload"], digest, nth, None if answer else (r["first_id"], r["first_url"], 0)):
                    members.append(zlib.compress((text + END).encode(), wbits=31))
                    size += len(members[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["archive"])
                    members, size = [], 0
        if members:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["archive"])

    # The text writer puts a string's bytes into a file as they are; a row is a file.
    archives = ready.mapInArrow(run, "archive binary").select(F.col("archive").cast("string").alias("value"))
    archives.write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive given in pieces; one record is held at a time."""
    buffer, at, source = bytearray(), 0, iter(chunks)

    def more() -> bool:
        nonlocal buffer, at
        if at:
            del buffer[:at]
            at = 0
        chunk = next(source, None)
        if chunk is None:
            return False
        buffer += chunk
        return True

    while True:
        while at < len(buffer) and buffer[at : at + 2] == b"\r\n":
            at += 2
        while (end := buffer.find(b"\r\n\r\n", at)) < 0 or len(buffer) - at < 10:
            if not more():
                if buffer[at:].strip():
                    raise ValueError("an archive ends within a record's header")
                return
            while buffer[at : at + 2] == b"\r\n":
                at += 2
        version, *lines = bytes(buffer[at:end]).decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no record where one is expected: {version[:40]!r}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(headers["content-length"])
        at = end + 4
        while len(buffer) - at < size:
            if not more():
                raise ValueError("an archive ends within a record's block")
        yield headers, bytes(buffer[at : at + size])
        at += size


def unzipped(content: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The bytes of a file, of any number of gzip members (zero bytes between and after them) or plain, in bounded pieces."""
    plain, packed = content[:2] != b"\x1f\x8b", None
    for i in range(0, len(content), step):
        data = content[i : i + step]
        if plain:
            yield data
            continue
        while data:
            if packed is None:
                data = data.lstrip(b"\0")
                if not data:
                    break
                packed = zlib.decompressobj(31)
            yield packed.decompress(data, 1 << 20)
            data = packed.unused_data if packed.eof else packed.unconsumed_tail
            if packed.eof:
                packed = None
    if packed is not None:
        raise ValueError("an archive ends within a member")


def read_records(spark: SparkSession, path: str, *, keep_payload: bool = False) -> DataFrame:
    """One row for each record of the archives: its identifiers, and the length and digest of its payload as read."""
    ddl, schema = DDL, SCHEMA
    if keep_payload:
        ddl, schema = f"{DDL}, payload binary", SCHEMA.append(pa.field("payload", pa.binary()))

    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind, page, size, digest, payload = headers.get("warc-type"), None, None, None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        elif kind == "revisit":
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        elif kind == "metadata":
            facts = dict(x.split(": ", 1) for x in block.decode().split("\r\n") if ": " in x)
            page = int(facts["page-id"]) if "page-id" in facts else None
        named = (headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-target-uri"), headers.get("warc-refers-to"), page, size, digest)
        return (*named, payload) if keep_payload else named

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for headers, block in parse(unzipped(content.as_py())):
                    rows.append(row(headers, block))
                    held += len(block) * keep_payload + 300
                    if held > 1 << 24:
                        yield as_batch(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield as_batch(rows, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, ddl)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row for each capture: structs main and request, array metadata, and the revisited response.

    A capture is a response or revisit record; request and metadata records
    join it by WARC-Concurrent-To.  Missing ones are null (an empty array);
    records that name no capture give no row; an empty table gives none.
    """
    main = records.filter(F.col("warc_type").isin("response", "revisit")).select("record_id", F.struct(*records.columns).alias("main"))
    linked = records.filter(F.col("concurrent_to").isNotNull())
    request = linked.filter("warc_type = 'request'").groupBy("concurrent_to").agg(F.min(F.struct("record_id", "target_uri")).alias("request"))
    metadata = linked.filter("warc_type = 'metadata'").groupBy("concurrent_to").agg(F.array_sort(F.collect_list(F.struct("record_id", "page_id"))).alias("metadata"))
    captures = (
        main.join(request.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
        .join(metadata.withColumnRenamed("concurrent_to", "record_id"), "record_id", "left")
        .withColumn("metadata", F.coalesce("metadata", F.array().cast("array<struct<record_id:string,page_id:bigint>>")))
    )
    # Materialised, so that both sides of the join are plain exchanges and the revisits of one response can be split.
    captures = cut_lineage(captures)
    target = captures.filter("main.warc_type = 'response'").select(
        F.col("record_id").alias("of"),
        F.struct(F.try_element_at("metadata", F.lit(1))["page_id"].alias("page_id"), F.col("main.payload_bytes").alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest")).alias("revisited"),
    )
    return captures.join(target.hint("shuffle_merge"), captures["main.refers_to"] == target["of"], "left").drop("of", "record_id")


def archive_round_trip(pages: DataFrame, *, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages, read the archives back and digest the captures.

    page_id, payload_bytes, payload_digest, record_type, refers_to; one row for
    each row of ``pages``, as ``write_archives`` and ``assemble`` define it for
    nulls and repeated rows.  Other columns are not read.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes=min_revisit_bytes)
    records = cut_lineage(read_records(spark, path))
    return assemble(records).select(
        F.try_element_at("metadata", F.lit(1))["page_id"].alias("page_id"),
        F.coalesce("main.payload_bytes", "revisited.payload_bytes").alias("payload_bytes"),
        F.col("main.payload_digest").alias("payload_digest"),
        F.col("main.warc_type").alias("record_type"),
        F.when(F.col("main.warc_type") == "revisit", F.col("revisited.page_id")).alias("refers_to"),
    )
