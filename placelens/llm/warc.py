"""WARC archives: write monolithic gzip streams, normalise them to one gzip member per record with an offset index, read back.

A crawl writer that compresses a whole file as one gzip stream leaves an archive that can only be read from its start.
`normalise` inflates such a stream once, in pieces, rewrites every record as its own member and writes a sidecar index
(record number, offset, length, type, record id), so that any record is one seek away. Files go to a folder that all
executors share, under a name that is new for each task attempt; a file counts only if the attempt that wrote it returned
its row, so attempts that were lost leave nothing behind in the tables.

Empty and null payloads are records of length 0; null ids and urls leave out their headers and come back null. Rows of one
page id and equal payload are alike: both are responses if that id is the largest of the payload. An empty table gives no
file and no row.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from placelens.llm.common import record_batch, stage, table
from placelens.session import shared_dir

REVISIT_BYTES = 1000            # payloads of at least this size are stored once
FILE_BYTES = 64 << 20           # a file is closed when its payloads reach this size
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = pa.schema([("path", pa.string()), ("records", pa.int64())])
INDEX = pa.schema([("path", pa.string()), ("record", pa.int64()), ("start", pa.int64()), ("size", pa.int64()),
                   ("record_type", pa.string()), ("record_id", pa.string())])
READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                  ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                  ("payload", pa.binary())])
FILES_DDL = "path string, records long"
INDEX_DDL = "path string, record long, start long, size long, record_type string, record_id string"
READ_DDL = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
            "payload binary")


def _open(path):
    fs, at = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
    return fs, at


def _record_id(page_id):
    return f"<urn:page:{page_id}>"


def encode_record(page_id, url, payload, digest, refers_to):
    """One WARC/1.1 record: a response with its HTTP header and payload, or a revisit without payload."""
    kind = "response" if refers_to is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
            "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
            f"WARC-Record-ID: {_record_id(page_id) if page_id is not None else f'<urn:uuid:{uuid.uuid4()}>'}"]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Records:
    """Splits a stream of bytes, fed in pieces, into whole WARC records."""

    def __init__(self):
        self.rest = bytearray()

    def feed(self, piece):
        self.rest += piece
        at = 0
        while True:
            stop = self.rest.find(b"\r\n\r\n", at)
            if stop < 0:
                break
            head = headers(bytes(self.rest[at:stop]))
            to = stop + 4 + int(head["content-length"]) + 4
            if to > len(self.rest):
                break
            yield head, bytes(self.rest[at:to])
            at = to
        del self.rest[:at]

    def close(self):
        if self.rest.strip():
            raise ValueError("the stream ends inside a WARC record")


def headers(raw):
    lines = raw.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _page(urn):
    return int(urn[len("<urn:page:"):-1]) if urn and urn.startswith("<urn:page:") else None


def decode_record(raw):
    """(page_id, url, payload bytes, digest, type, refers_to, payload) of one record; a revisit's payload is null."""
    stop = raw.index(b"\r\n\r\n")
    head = headers(raw[:stop])
    block = raw[stop + 4:stop + 4 + int(head["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    told = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    if head["warc-type"] == "response":
        if hashlib.sha1(payload).hexdigest() != told or len(payload) != size:
            raise ValueError("payload does not match its digest")
    else:
        payload = None
    return (_page(head["warc-record-id"]), head.get("warc-target-uri"), size, told, head["warc-type"],
            _page(head.get("warc-refers-to")), payload)


def mark_revisits(pages):
    """Columns page_id, url, payload, digest, refers_to: the largest page id of equal payloads of at least REVISIT_BYTES
    is the response, others refer to it.

    The maximum per digest is pre-aggregated; the join back is a shuffle join whose hot digests AQE can split.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"))
    first = pages.where(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(
        F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    pages = pages.join(first, "digest", "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return pages.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def write_monolithic(marked, folder):
    """Write each partition's records as whole-file gzip streams; returns the table of files."""
    def write(batches):
        out = None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                page_id, url, payload, digest, refers_to = row
                if out is None:
                    path, records, size = f"{folder}/{uuid.uuid4().hex}.whole.warc.gz", 0, 0
                    fs, at = _open(path)
                    out, gz = fs.open_output_stream(at, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(gz.compress(encode_record(page_id, url, payload, digest, refers_to)))
                records, size = records + 1, size + len(payload)
                if size >= FILE_BYTES:
                    out.write(gz.flush())
                    out.close()
                    out = None
                    yield record_batch(FILES, [path], [records])
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield record_batch(FILES, [path], [records])

    return marked.mapInArrow(write, FILES_DDL)


def normalise(files, folder):
    """Inflate each monolithic file once, rewrite its records as gzip members, write `<file>.idx`; returns all index rows.

    One task holds a piece of the stream and one record at a time, whatever the size of the file.
    """
    def rewrite(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _open(path)
                to = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                fs_to, at_to = _open(to)
                rows, inflate, records, start = [], zlib.decompressobj(31), Records(), 0
                with fs.open_input_stream(at, compression=None) as source, \
                        fs_to.open_output_stream(at_to, compression=None) as out:
                    while piece := source.read(CHUNK):
                        while piece:
                            for head, raw in records.feed(inflate.decompress(piece, 4 * CHUNK)):
                                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                                member = gz.compress(raw) + gz.flush()
                                out.write(member)
                                rows.append((to, len(rows), start, len(member), head["warc-type"], head["warc-record-id"]))
                                start += len(member)
                            piece = inflate.unconsumed_tail
                            if inflate.eof and not piece:       # the source may itself consist of several members
                                piece, inflate = inflate.unused_data, zlib.decompressobj(31)
                records.close()
                with fs_to.open_output_stream(f"{at_to}.idx", compression=None) as out:
                    out.write("".join("\t".join(map(str, r[1:])) + "\n" for r in rows).encode())
                for k in range(0, len(rows), 10_000):
                    yield record_batch(INDEX, *zip(*rows[k:k + 10_000]))

    return files.select("path").mapInArrow(rewrite, INDEX_DDL)


def read_index(path):
    """The sidecar index of one normalised archive: (record, offset, size, type, record id) rows."""
    fs, at = _open(path)
    with fs.open_input_stream(f"{at}.idx", compression=None) as source:
        return [(int(a), int(b), int(c), d, e) for a, b, c, d, e in
                (x.split("\t") for x in source.read().decode().splitlines())]


def read_member(path, start, size):
    """One record, by its place in the archive."""
    fs, at = _open(path)
    with fs.open_input_file(at) as source:
        return decode_record(zlib.decompress(source.read_at(size, start), 31))


def read_records(archives, payload=True):
    """All records of the normalised archives (column path), found through their sidecar indexes; digests are verified."""
    def read(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = _open(path)
                with fs.open_input_file(at) as source:
                    rows, held = [], 0
                    for _, start, size, _, _ in read_index(path):
                        row = decode_record(zlib.decompress(source.read_at(size, start), 31))
                        rows.append(row if payload else (*row[:-1], None))
                        held += size if payload else 1
                        if held >= 4 * CHUNK or len(rows) >= 5000:
                            yield record_batch(READ, *zip(*rows))
                            rows, held = [], 0
                    if rows:
                        yield record_batch(READ, *zip(*rows))

    return archives.select("path").mapInArrow(read, READ_DDL)


def archive_pages(pages, payload=False):
    """Write `pages` (page_id, url, html) as monolithic archives, normalise them and read every record back."""
    spark = pages.sparkSession
    folder = shared_dir(spark, "warc")
    files, _ = stage(write_monolithic(mark_revisits(pages), folder), "warc-files")
    index, _ = stage(normalise(_spread(files), folder), "warc-index")
    return read_records(_spread(index.select("path").distinct()), payload)


def _spread(files):
    """File names are few and small; deal them to all cores."""
    spark = files.sparkSession
    return files.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def op3_warc(spark, sf_dir):
    return archive_pages(table(spark, sf_dir, "pages")).drop("payload", "url")
