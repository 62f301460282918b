"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

The writer trains a dictionary on a bounded sample and writes rolled archives to a shared folder; records whose payload
another one has are revisits. The reader loads the dictionary of each archive, decodes frame by frame, and checks
versions, headers, lengths and digests of every record.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, scratch_path

#: Fixed values of the format: magic of the skippable frame with a dictionary, and of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_TYPE, HTTP_MESSAGE = "text/html; charset=utf-8", "application/http; msgtype=response"
#: Date that all records carry, so that a rerun writes the same bytes.
DATE = "2024-01-01T00:00:00Z"
#: Compressed bytes after which an archive is closed, rows and bytes that the dictionary is trained on, and its size.
ROLL, SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY, LEVEL = 16_000_000, 400, 4_000_000, 65_536, 6
#: A record in memory at most, and compressed bytes given to a frame at once.
MOST, WINDOW = 1 << 31, 1 << 16


class WarcError(ValueError):
    """An archive or record that isn't as the format wants it."""


@dataclass
class Record:
    """A record's headers (names in lower case), its HTTP headers and its payload as stored."""

    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id) -> str:
    return f"<urn:tidemark:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    """The page id in a record id."""
    head, _, number = identifier.strip("<>").rpartition(":")
    if head != "urn:tidemark:page" or not (number == "" or number.lstrip("-").isdigit()):
        raise WarcError(f"unknown record id {identifier}")
    return int(number) if number else None


def _uri(url: str | None) -> str:
    """A URL without what would end a header line."""
    return "".join(c if c > " " and c != "\x7f" else "%" + format(b, "02X") for c in url or "about:blank" for b in ([ord(c)] if c <= " " or c == "\x7f" else [0]))


def write_record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record; a revisit keeps the HTTP headers alone, whose Content-Length is that of the full payload."""
    digest = base32(hashlib.sha1(payload).digest())
    http = f"HTTP/1.1 200 OK\r\nContent-Type: {HTTP_TYPE}\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"Content-Type: {HTTP_MESSAGE}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _header_lines(raw: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:80]!r}")
        if name.lower() in found:
            raise WarcError(f"header {name} twice")
        found[name.lower()] = value.strip()
    return found


def read_record(raw: bytes) -> Record:
    """Parses and checks one record: version, needed headers, lengths, block digest, and payload digest of responses."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if not gap or version.decode("latin-1") not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError("no WARC version line")
    headers = _header_lines(lines)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"header {name} is missing")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, not {n}")
    block = rest[:n]
    for name, data in (("warc-block-digest", block),):
        if name in headers and headers[name] != f"sha1:{base32(hashlib.sha1(data).digest())}":
            raise WarcError(f"{name} differs")
    if headers["warc-type"] not in ("response", "revisit"):
        return Record(headers, {}, block)
    head, gap, payload = block.partition(b"\r\n\r\n")
    status, _, lines = head.partition(b"\r\n")
    if not gap or not status.startswith(b"HTTP/1."):
        raise WarcError("no HTTP status line")
    http = _header_lines(lines) if lines else {}
    if not http.get("content-length", "").isdigit():
        raise WarcError("HTTP Content-Length is missing")
    if headers["warc-type"] == "response":
        if len(payload) != int(http["content-length"]) or headers.get("warc-payload-digest") != f"sha1:{base32(hashlib.sha1(payload).digest())}":
            raise WarcError("the payload isn't what its headers say")
    elif "warc-refers-to" not in headers or "warc-payload-digest" not in headers or payload:
        raise WarcError("a revisit lacks its target or digest, or has a payload")
    return Record(headers, http, payload)


def skippable(dictionary: bytes) -> bytes:
    """The leading frame with a dictionary."""
    return struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary


def read_archive(raw: bytes) -> Iterator[Record]:
    """Records of an archive: the dictionary from the leading skippable frame, if there is one, then a record a frame."""
    import zstandard as zstd

    at, known = 0, None
    if len(raw) >= 8 and struct.unpack_from("<I", raw)[0] == SKIPPABLE:
        n = struct.unpack_from("<I", raw, 4)[0]
        if 8 + n > len(raw):
            raise WarcError("the dictionary is cut off")
        body = raw[8 : 8 + n]
        if body[:4] == struct.pack("<I", FRAME):  # it may be compressed itself
            body = zstd.ZstdDecompressor().decompress(body, max_output_size=MOST)
        known, at = zstd.ZstdCompressionDict(body), 8 + n
    reader = zstd.ZstdDecompressor(dict_data=known) if known else zstd.ZstdDecompressor()
    view = memoryview(raw)
    while at < len(raw):
        if len(raw) - at < 8 or struct.unpack_from("<I", raw, at)[0] != FRAME:
            raise WarcError(f"no frame at {at}")
        size = zstd.frame_content_size(view[at : at + 18])
        frame, parts, total, upto = reader.decompressobj(), [], 0, at
        try:
            while not frame.eof and upto < len(raw):  # a frame is given windows of the archive, not all that follows
                parts.append(frame.decompress(view[upto : upto + WINDOW]))
                upto, total = min(len(raw), upto + WINDOW), total + len(parts[-1])
                if max(size, total) > MOST:
                    raise WarcError(f"the frame at {at} is too large")
        except zstd.ZstdError as error:
            raise WarcError(f"frame at {at}: {error}") from error
        if not frame.eof or (size >= 0 and total != size):
            raise WarcError(f"the frame at {at} is cut off")
        yield read_record(b"".join(parts))
        at = upto - len(frame.unused_data)


def train_dictionary(pages: DataFrame, html_col: str = "html") -> bytes:
    """A dictionary from at most SAMPLE_ROWS rows and SAMPLE_BYTES bytes; none where the rows are too few or alike."""
    import zstandard as zstd

    rows = pages.filter(F.length(html_col).between(1, 100_000)).select(html_col).limit(SAMPLE_ROWS).collect()
    samples, total = [], 0
    for (text,) in rows:
        raw = write_record(0, None, text.encode())
        if total + len(raw) > SAMPLE_BYTES:
            break
        samples.append(raw)
        total += len(raw)
    if len(samples) < 8:
        return b""
    try:
        return zstd.train_dictionary(min(DICTIONARY, max(1024, total // 10)), samples).as_bytes()
    except zstd.ZstdError:
        return b""


def roles(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", least: int = 0) -> DataFrame:
    """The pages with record_type and refers_to: of equal payloads of at least `least` bytes the smallest id responds.

    Columns of these names that the pages have are replaced.

    Payloads are compared by SHA-1 and length. Only groups of two and more are joined back, so the join's other side
    holds one row for each repeated payload; Spark splits the partition of one that very many pages share.
    """
    body = F.coalesce(F.col(html_col), F.lit(""))
    marked = pages.select("*", F.sha1(body.cast("binary")).alias("_tm_sha1"), F.octet_length(body).cast("long").alias("_tm_bytes"))
    groups = marked.filter(F.col("_tm_bytes") >= least).groupBy("_tm_sha1", "_tm_bytes").agg(F.min(id_col).alias("_tm_first"), F.count("*").alias("_tm_n")).filter("_tm_n > 1").drop("_tm_n")
    joined = marked.join(groups, ["_tm_sha1", "_tm_bytes"], "left")
    revisit = F.col("_tm_first").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("_tm_first"))
    return joined.select(*[c for c in pages.columns if c not in ("record_type", "refers_to")], F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("_tm_first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a record for each page to archives in `folder` and returns the manifest: archive, records, bytes.

    The folder is a URI that executors share. Each task writes files of its own, named at random, in full before their
    manifest row counts; what a lost attempt left is in no manifest and so never read.
    """
    dictionary = train_dictionary(pages, html_col)
    rows = roles(pages, id_col, html_col, least).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), "record_type", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard as zstd
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        known = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        writer = zstd.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
        parts, size = [], 0

        def close() -> pa.RecordBatch:
            nonlocal parts, size
            path = f"{root}/{uuid.uuid4().hex}.warc.zst"
            lead = skippable(dictionary) if dictionary else b""
            with store.open_output_stream(path) as out:
                out.write(lead)
                for p in parts:
                    out.write(p)
            done = pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]]), pa.array([len(parts)], pa.int64()), pa.array([size + len(lead)], pa.int64())], names=["archive", "records", "bytes"])
            parts, size = [], 0
            return done

        store.create_dir(root, recursive=True)
        for batch in batches:
            for row in batch.to_pylist():
                payload = (row["html"] or "").encode()
                parts.append(writer.compress(write_record(row["id"], row["url"], payload, row["refers_to"], row["record_type"] == "revisit")))
                size += len(parts[-1])
                if size >= ROLL:
                    yield close()
        if parts:
            yield close()

    return saved(rows.mapInArrow(run, "archive string, records long, bytes long"), "manifest")[0]


def read(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the archives in a manifest: page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Raises WarcError where an archive or a record is broken, or an archive holds another number of records than the
    manifest says. payload (of responses) is added on demand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for archive, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(f"{root}/{archive}") as file:
                    raw = file.read()
                rows, size, seen = [], 0, 0
                for r in read_archive(raw):
                    target = r.headers.get("warc-refers-to")
                    rows.append((page_of(r.headers["warc-record-id"]), int(r.http["content-length"]), r.headers["warc-payload-digest"].removeprefix("sha1:"), r.headers["warc-type"], page_of(target) if target else None, r.headers.get("warc-target-uri"), r.payload if with_payload else None))
                    size, seen = size + len(r.payload) * with_payload, seen + 1
                    if len(rows) >= 10_000 or size >= 16_000_000:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)
                if seen != records:
                    raise WarcError(f"{archive} holds {seen} records, not {records}")

    def out(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
    many = manifest.select("archive", "records").repartition(max(1, min(100_000, manifest.count())))
    found = many.mapInArrow(run, schema)
    return found if with_payload else found.drop("payload")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back; the result of read().

    Null html is an empty payload. Rows that share both the smallest id and the payload of a group are all responses; a
    null id is a revisit of a smaller one, and a response where its group has none. No rows give none.
    """
    folder = scratch_path(pages.sparkSession, "archives")
    return read(write(pages, folder, id_col, url_col, html_col, least), folder)
