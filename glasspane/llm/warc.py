"""WARC archives in seekable Zstandard bundles.

Each task writes its pages as WARC/1.1 records into bundle files: runs of records of about `FRAME_BYTES` are one
independent Zstandard frame each, and a bundle ends with the seek table of the seekable format (a skippable frame with the
compressed and plain size of every frame). The index maps each record id to bundle, frame and offset within the frame, so
one record is read by decompressing one frame. A bundle is written under a name of its own per attempt, and only the index
says which bundles count, so a task that is run again leaves no half-written data in the result.

Of records with equal payloads of at least `least` bytes, that with the smallest page_id is a response with the payload;
the others are revisits that refer to it (identical-payload-digest) and hold only the HTTP header, whose Content-Length is
that of the full payload. First pages are found on digests alone, by a partial and final minimum, and who refers to whom is
settled on ids and digests; only then are the payloads joined to that, by id, so that copies of one payload never meet.
Archives are read back by frames, in as many tasks as their bytes ask for.

Defined cases: null html is an empty payload; a null url gives no target URI; rows that repeat the first page_id are all
responses; a null page_id is never referred to, and is a response unless another page has the payload; line ends in urls
are percent-encoded; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, record_batch, settle, shared_dir

FRAME_BYTES, BUNDLE_BYTES, LEVEL = 1 << 19, 64 << 20, 3
#: Compressed bytes of frames that a task reads back, about.
READ_BYTES = 4 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
URN, PROFILE = "urn:page:", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, record_id string, bundle string, frame int, frame_start long, frame_bytes long, at long, length long"
INDEX_SCHEMA = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("frame_start", pa.int64()), ("frame_bytes", pa.int64()), ("at", pa.int64()), ("length", pa.int64())])
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def base32_sha1(col: F.Column) -> F.Column:
    """Bare upper-case base32 of the SHA-1 of a binary column."""
    h = F.sha1(col)
    # 40 bits at a time: ten hex digits are eight digits to base 32.
    part = lambda i: F.lpad(F.conv(F.substring(h, 1 + 10 * i, 10), 16, 32), 8, "0")
    return F.translate(F.upper(F.concat(*map(part, range(4)))), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """Record id and the whole record."""
    name = f"{URN}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = head + payload if refers_to is None else head
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return name, "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class Bundle:
    """One file of frames with a seek table, written under `folder`."""

    def __init__(self, folder: str, level: int = LEVEL):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, path = fs.FileSystem.from_uri(self.path)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.sizes: list[tuple[int, int]] = []
        self.start = self.plain = 0

    def frame(self, data: bytes) -> tuple[int, int, int]:
        """Number, start and compressed size of a new frame."""
        packed = self.zstd.compress(data)
        self.out.write(packed)
        at = (len(self.sizes), self.start, len(packed))
        self.sizes.append((len(packed), len(data)))
        self.start += len(packed)
        self.plain += len(data)
        return at

    def close(self) -> None:
        body = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


def seek_table(path: str) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame of a bundle, from its last bytes."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        size = f.size()
        n, flags, magic = struct.unpack("<IBI", f.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        width = 12 if flags & 0x80 else 8
        body = f.read_at(n * width, size - 9 - n * width)
    found, start = [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", body, i * width)
        found.append((start, packed, plain))
        start += packed
    return found


def read_frame(path: str, start: int, size: int) -> bytes:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return zstandard.ZstdDecompressor().decompressobj().decompress(f.read_at(size, start))


def read_record(bundle: str, frame_start: int, frame_bytes: int, at: int, length: int) -> bytes:
    """One record by the columns of its index row."""
    return read_frame(bundle, frame_start, frame_bytes)[at : at + length]


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case names), block, and where the next record starts."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode("utf-8").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    stop = end + 4 + int(fields["content-length"])
    return fields, data[end + 4 : stop], stop + 4


def page_number(name: str) -> int | None:
    name = name.strip("<>")
    return int(name[len(URN) :]) if name.startswith(URN) else None


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write bundles under `folder` (default: a new one in the shared folder) and return the settled index of their records."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload")).withColumn("digest", base32_sha1(F.col("payload")))
    ids = rows.where(F.length("payload") >= least).select("page_id", "digest")
    firsts = ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first")
    revisits = ids.distinct().join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("first").alias("refers_to"))
    typed = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "payload", "digest", "refers_to")

    def write(batches):
        bundle, held, plain = None, [], bytearray()

        def close_frame():
            frame, start, size = bundle.frame(bytes(plain))
            ids, names, at, length = zip(*held, strict=True)
            n = len(held)
            out = record_batch(INDEX_SCHEMA, list(ids), list(names), [bundle.path] * n, [frame] * n, [start] * n, [size] * n, list(at), list(length))
            held.clear()
            plain.clear()
            return out

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in columns)
                bundle = bundle or Bundle(folder)
                name, data = record(page_id, url, payload, digest, refers_to, date)
                held.append((page_id, name, len(plain), len(data)))
                plain += data
                if len(plain) >= FRAME_BYTES:
                    yield close_frame()
                    if bundle.plain >= BUNDLE_BYTES:
                        bundle.close()
                        bundle = None
        if held:
            yield close_frame()
        if bundle:
            bundle.close()

    return settle(typed.mapInArrow(write, INDEX), "warc-index")


def read_archives(bundles: DataFrame) -> DataFrame:
    """From a table with a column `bundle` of paths: every record of these archives, read frame by frame."""

    def frames(batches):
        schema = pa.schema([("bundle", pa.string()), ("start", pa.int64()), ("size", pa.int64())])
        for batch in batches:
            for path in batch.column("bundle").to_pylist():
                table = seek_table(path)
                yield record_batch(schema, [path] * len(table), [t[0] for t in table], [t[1] for t in table])

    def records(batches):
        for batch in batches:
            for path, start, size in zip(*(batch.column(c).to_pylist() for c in ("bundle", "start", "size")), strict=True):
                data, at, rows = read_frame(path, start, size), 0, []
                while at < len(data):
                    fields, block, at = parse(data, at)
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    kind, size = fields["warc-type"], len(payload)
                    if kind == "revisit":
                        size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    elif digest != (digest := base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                        raise ValueError(f"payload of {fields['warc-record-id']} in {path} does not match its digest")
                    refers = fields.get("warc-refers-to")
                    rows.append((page_number(fields["warc-record-id"]), size, digest, kind, page_number(refers) if refers else None))
                yield record_batch(RECORD_SCHEMA, *(list(c) for c in zip(*rows, strict=True)))

    listed = settle(bundles.select("bundle").distinct().mapInArrow(frames, "bundle string, start long, size long"), "warc-frames")
    total = listed.agg(F.sum("size")).first()[0] or 0
    return listed.repartition(max(1, -(-total // READ_BYTES)), "bundle", "start").mapInArrow(records, RECORDS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(read_table(spark, sf_dir, "pages")))
