"""WARC archives in Zstandard with a shared dictionary: writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D, length, dictionary); each record is one Zstandard frame made
with that dictionary. The reader loads the dictionary from the leading frame, decodes one frame per record as it streams
through the file, and validates magic, version line, mandatory headers, record and HTTP lengths, the record's end and
the payload digest; whatever is wrong raises ValueError naming the archive and the record.

A payload that other pages also have is stored once, with the smallest page_id; the others are revisit records, which keep
the HTTP header (so the payload's length can be read back) and name the response.

Archives go to the shared checkpoint folder through its file system. A task's archives have names of their own, and
only those that a finished task reported are read, so a task that is run again leaves nothing wrong behind.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, small

MAGIC = 0x184D2A5D
DICT_BYTES, SAMPLES, SAMPLE_BYTES = 32_768, 256, 16_384
ARCHIVE_BYTES = 64 << 20
VERSION = b"WARC/1.1"
_END = b"\r\n\r\n"


def train_dictionary(pages: DataFrame) -> bytes:
    """From the first ``SAMPLES`` payloads, ``SAMPLE_BYTES`` of each at most; too few to train on: these bytes themselves."""
    rows = pages.where("length(html) > 0").select(F.substring("html", 1, SAMPLE_BYTES // 4).alias("h")).limit(SAMPLES).collect()
    samples = [r["h"].encode() for r in rows]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICT_BYTES] or b"<!DOCTYPE html><html><head>"


def _base32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def render(row: dict, payload: bytes) -> bytes:
    """One record: WARC header, HTTP header and, unless it is a revisit, the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % row.get("payload_bytes", len(payload))
    block = http if row["record_type"] == "revisit" else http + payload
    target = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in row["url"] or "urn:none")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{row['rid']}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
        f"WARC-Page-ID: {'' if row['page_id'] is None else row['page_id']}", f"WARC-Payload-Digest: sha1:{_base32(row['digest'])}", "Content-Type: application/http; msgtype=response",
    ]
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_rid']}>", f"WARC-Refers-To-Page-ID: {'' if row['refers_to'] is None else row['refers_to']}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + _END + block + _END


def parse(record: bytes, where: str) -> dict:
    """Headers, lengths and payload of one decoded record, validated."""
    head, cut_, rest = record.partition(_END)
    lines = head.split(b"\r\n")
    if not cut_ or lines[0] != VERSION:
        raise ValueError(f"{where}: no {VERSION.decode()} header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError(f"{where}: header line without a colon")
        fields[name.decode().lower()] = value.strip().decode()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} - set(fields)
    if missing:
        raise ValueError(f"{where}: headers {sorted(missing)} are missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != _END:
        raise ValueError(f"{where}: Content-Length {fields['content-length']} is not that of the block, {len(rest) - 4}")
    http, cut_, payload = rest[:-4].partition(_END)
    length = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), b"")
    if not cut_ or not http.startswith(b"HTTP/") or not length.isdigit():
        raise ValueError(f"{where}: no HTTP header with a length")
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(length) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"{where}: the payload has another length or digest")
    if kind not in ("response", "revisit") or (kind == "revisit" and payload):
        raise ValueError(f"{where}: type {kind} or a payload that a revisit must not have")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    return {"page_id": number("warc-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "refers_to": number("warc-refers-to-page-id"), "payload_bytes": int(length), "payload_digest": digest, "payload": payload if kind == "response" else None}


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def read_archive(path: str, chunk: int = 1 << 20) -> Iterator[dict]:
    """The records of one archive in order; memory holds a chunk, the dictionary and one record."""
    system, inner = _open(path)
    with system.open_input_stream(inner, compression=None) as file:
        lead = file.read(8)
        magic, size = struct.unpack("<II", lead) if len(lead) == 8 else (0, 0)
        words = file.read(size) if magic == MAGIC else b""
        if magic != MAGIC or len(words) != size:
            raise ValueError(f"{path}: no dictionary frame in front")
        if words[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
            words = zstandard.ZstdDecompressor().decompress(words)
        context = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words))
        held, frame, parts, n = b"", None, [], 0
        while True:
            if not held and not (held := file.read(chunk)):
                if frame is not None:
                    raise ValueError(f"{path}, record {n}: the file ends inside a frame")
                return
            frame = frame or context.decompressobj()
            try:
                parts.append(frame.decompress(held))
            except zstandard.ZstdError as e:
                raise ValueError(f"{path}, record {n}: {e}") from e
            held = b""
            if frame.eof:
                held, frame = frame.unused_data, None
                yield parse(b"".join(parts), f"{path}, record {n}")
                parts, n = [], n + 1


def plan_records(pages: DataFrame) -> DataFrame:
    """(rid, page_id, url, payload, payload_bytes, digest, record_type, refers_to, refers_rid), a row for each row of ``pages``.

    Revisits have no payload and are made from ids alone; payloads are joined, if at all, by page_id, url and digest, never by
    a digest that many pages share. Rows equal in all three are told apart by their number only, so nothing depends on
    the order in which rows come.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    key, place = ["page_id", "url", "digest"], F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "url")
    keys = cut(rows.groupBy(*key).agg(F.count("*").alias("n"), F.first(F.octet_length("payload")).alias("payload_bytes")))
    shared = cut(keys.groupBy("digest").agg(F.min(place).alias("first"), F.sum("n").alias("of")).where("of > 1").select("digest", "first"))
    marked = keys.join(small(shared, shared.count()), "digest", "left").withColumn("again", F.col("first").isNotNull() & (place != F.col("first")))
    marked = cut(marked.withColumn("first", F.coalesce("first", place)).where("again or n > 1"))  # all but the single responses

    def rid(page_id: Column, url: Column, number: Column) -> Column:
        return F.sha1(F.to_json(F.struct(page_id.alias("p"), url.alias("u"), F.col("digest"), number.alias("k"))))

    own = rid(F.col("page_id"), F.col("url"), F.col("copy"))
    copies = F.sequence(F.when(F.col("again"), 0).otherwise(1), F.col("n").cast("int") - 1)
    revisits = marked.withColumn("copy", F.explode(copies)).select(
        own.alias("rid"), *key, F.lit(None).cast("binary").alias("payload"), "payload_bytes", F.lit("revisit").alias("record_type"), F.col("first.page_id").alias("refers_to"), rid(F.col("first.page_id"), F.col("first.url"), F.lit(0)).alias("refers_rid")
    )
    told = marked.select(*(F.col(c).alias(f"of_{c}") for c in key), "again")
    same = (F.col("digest") == F.col("of_digest")) & F.col("page_id").eqNullSafe(F.col("of_page_id")) & F.col("url").eqNullSafe(F.col("of_url"))
    found = rows.join(small(told, told.count()), same, "left")
    stored_once = found.where("again is null").select(*key, "payload")
    if not told.where("not again").isEmpty():  # of rows equal in all one payload is stored
        stored_once = stored_once.union(found.where("not again").groupBy(*key).agg(F.first("payload").alias("payload")).select(*key, "payload"))
    none = F.lit(None)
    responses = stored_once.withColumn("copy", F.lit(0)).select(
        own.alias("rid"), *key, "payload", F.octet_length("payload").alias("payload_bytes"), F.lit("response").alias("record_type"), none.cast("long").alias("refers_to"), none.cast("string").alias("refers_rid")
    )
    return responses.union(revisits)


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all ``pages`` and return (path, records, bytes) of the archives, cut so that it is never written twice."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    words = train_dictionary(pages)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, inner = _open(folder)
        system.create_dir(inner, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True)
        done, file, path, records, size = [], None, "", 0, 0

        def close():
            nonlocal file
            if file is not None:
                file.close()
                done.append((path, records, size))
                file = None

        for batch in batches:
            batch = batch.astype({"page_id": "Int64", "refers_to": "Int64"})
            for row in batch.to_dict("records"):
                row = {k: None if v is pd.NA else v for k, v in row.items()}
                if file is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.zst", 0, 0
                    file = system.open_output_stream(f"{inner}{path.removeprefix(folder)}", compression=None)
                    file.write(struct.pack("<II", MAGIC, len(words)) + words)
                frame = packer.compress(render(row, row.pop("payload") or b""))
                file.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    close()
        close()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return cut(plan_records(pages).mapInPandas(write, "path string, records long, bytes long"))


_FIELDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """All records of the archives named in column ``path``; without ``payload`` it is checked, but not returned."""
    names = [f.split()[0] for f in _FIELDS.split(", ")] + ["payload"] * payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows, held = [], 0
                for record in read_archive(path):
                    rows.append([record[c] for c in names])
                    held += len(record["payload"] or b"") if payload else 1
                    if held >= 8 << 20 or len(rows) >= 4096:
                        yield _frame(rows, names)
                        rows, held = [], 0
                yield _frame(rows, names)

    return archives.select("path").mapInPandas(read, _FIELDS + ", payload binary" * payload)


def _frame(rows: list[list], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, read back from its archive.

    Null html is an empty payload; equal payloads, empty ones too, share one response: that of the smallest page_id (of
    rows that repeat it, one). A page without id gets a record without one, and is the response only if no page with an
    id has its payload. An empty table gives no archives and no rows; only page_id, url and html are read.
    Pages may be of any length: a record is one page, read and written as a whole.
    """
    return read_archives(write_archives(pages), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
