"""WARC archives as Zstandard files: writer, reader and digest-based revisits.

A file begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself a
Zstandard frame; after it each record is one frame of its own. The reader loads the dictionary from
that frame, walks the frames by their block headers, decodes one frame per record and validates
version line, headers, lengths, record end and digests.

Files go to the shared folder through a file system named by URI, first under a temporary name
that is then renamed; names hold the attempt, and only the files of attempts that succeeded are
in the manifest, so a task that is lost and run again adds no record twice. Tasks read the files that
the manifest, a table, names. A file is closed at ``file_bytes``, so each fits one task.

Defined results: a null html is an empty payload; a null url is written without a target; a null
page_id ranks lowest. Of equal payloads of at least ``least`` bytes the largest page_id is the
response and other page_ids revisit it; rows that repeat that page_id with that payload are
responses too. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import lean
from tessera.session import as_uri, checkpoint_root, saved, temporary

SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
FILE_BYTES = 16 << 20
#: Tasks that read archives.
MOST_TASKS = 20_000
DICTIONARY_BYTES, SAMPLES = 64 << 10, 400
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


class Malformed(ValueError):
    """A file or record that breaks the format."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    if not (uri.startswith("<urn:page:") and uri.endswith(">")):
        raise Malformed(f"not a page's identifier: {uri}")
    return None if uri == "<urn:page:null>" else int(uri[10:-1])


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header, whose length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=chr(37) + ':/?#[]@!$&()*+,;=~-._')}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of a record whose headers, lengths and digests are right; else Malformed."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Malformed("no WARC version line")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(":")
        if not colon or not k or k != k.strip():
            raise Malformed(f"not a header: {line}")
        fields[k.lower()] = v.strip()
    for k in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if k not in fields:
            raise Malformed(f"{k} is missing")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Malformed("the block's length is not Content-Length")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise Malformed("the block's digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise Malformed("no HTTP header")
    sizes = [x.split(b":")[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if len(sizes) != 1 or not sizes[0].isdigit():
        raise Malformed("no HTTP length")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
    if kind == "response" and (len(payload) != int(sizes[0]) or digest != f"sha1:{sha1_base32(payload)}"):
        raise Malformed("the payload's length or digest differs")
    if kind == "revisit" and (payload or not digest.startswith("sha1:") or "warc-refers-to" not in fields or fields.get("warc-profile") != PROFILE):
        raise Malformed("not a revisit of an identical payload")
    if kind not in ("response", "revisit"):
        raise Malformed(f"type {kind}")
    url = fields.get("warc-target-uri")
    return {
        "page_id": _page(fields["warc-record-id"]), "payload_bytes": int(sizes[0]), "payload_digest": digest[5:], "record_type": kind,
        "refers_to": _page(fields["warc-refers-to"]) if kind == "revisit" else None, "url": None if url is None else unquote(url), "payload": payload if kind == "response" else None,
    }


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its header and block headers."""
    if len(data) < at + 6 or struct.unpack_from("<I", data, at)[0] != FRAME:
        raise Malformed(f"no frame at {at}")
    d = data[at + 4]
    single, check = d >> 5 & 1, d >> 2 & 1
    at += 5 + (not single) + (0, 1, 2, 4)[d & 3] + ((1 if single else 0), 2, 4, 8)[d >> 6]
    while True:
        if at + 3 > len(data):
            raise Malformed("a frame is cut off")
        b = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        at += 3 + (1 if b >> 1 & 3 == 1 else b >> 3)
        if b & 1:
            break
    if (at := at + 4 * check) > len(data):
        raise Malformed("a frame is cut off")
    return at


def read(data: bytes):
    """Records of a file, one per frame."""
    view = memoryview(data).cast("B")
    if len(view) < 8 or struct.unpack_from("<I", view, 0)[0] != SKIPPABLE:
        raise Malformed("no dictionary frame at the start")
    size = struct.unpack_from("<I", view, 4)[0]
    at = 8 + size
    if at > len(view):
        raise Malformed("the dictionary frame is cut off")
    held = bytes(view[8:at])
    if held[:4] == struct.pack("<I", FRAME):
        held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
    decode = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held)) if held else zstandard.ZstdDecompressor()
    while at < len(view):
        end = frame_end(view, at)
        yield parse(decode.decompressobj().decompress(view[at:end]))
        at = end


class Writer:
    """Bytes of one file; the dictionary is trained on the first payloads of the task."""

    def __init__(self, dictionary: bytes):
        self.parts = [struct.pack("<II", SKIPPABLE, len(held := zstandard.ZstdCompressor(level=9).compress(dictionary) if dictionary else b"")), held]
        self.size = 8 + len(held)
        kind = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.encode = zstandard.ZstdCompressor(level=3, write_checksum=True, **kind)

    def add(self, data: bytes) -> None:
        self.parts.append(self.encode.compress(data))
        self.size += len(self.parts[-1])


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for records like ``samples``; empty where they are too few or too short to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def marked(pages: DataFrame, least: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, payload and the page that keeps the payload (``keep_id``).

    Digests and the largest page_id of each are aggregated before anything is joined, and only
    payloads with more than one page take part in the join, which Spark may split by rows.
    """
    p = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), F.coalesce(pages[html], F.lit("")).alias("html"))
    p = p.withColumn("key", F.concat_ws("/", F.octet_length("html"), F.sha2("html", 256)))
    kept = p.where(F.octet_length("html") >= least).groupBy("key").agg(F.max("page_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "keep_id")
    return p.join(kept, "key", "left").select("page_id", "url", "html", "keep_id")


def write(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES, **named) -> DataFrame:
    """Write the archives and return their manifest: a saved table of the files' paths (one for each ``file_bytes`` or task)."""
    @lean
    def task(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        n, out, pid, attempt = 0, None, TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()

        def close():
            final = f"part-{pid:06d}-{attempt}-{n:05d}.warc.zst"
            with store.open_output_stream(f"{base}/.{final}.tmp") as f:
                for x in out.parts:
                    f.write(x)
            store.move(f"{base}/.{final}.tmp", f"{base}/{final}")
            return f"{folder}/{final}"

        dictionary = None
        for b in batches:
            rows = zip(*[b.column(i).to_pylist() for i in range(4)])
            for page, url, html, keep in rows:
                payload = html.encode("utf-8", "surrogatepass")
                if dictionary is None:
                    head = b.column(2).slice(0, SAMPLES).to_pylist()
                    dictionary = train([record(0, None, x.encode("utf-8", "surrogatepass")) for x in head])
                out = out or Writer(dictionary)
                revisit = keep is not None and page != keep
                out.add(record(page, url, payload, keep, revisit))
                if out.size >= file_bytes:
                    yield pa.record_batch([[close()]], names=["path"])
                    n, out = n + 1, None
        if out:
            yield pa.record_batch([[close()]], names=["path"])

    # a row stands only for a file of an attempt that succeeded
    return saved(marked(pages, **named).mapInArrow(task, "path string"), "warc-files")


def load(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Records of the archives that the manifest ``files`` names: page_id, payload_bytes, payload_digest, record_type, refers_to, url (, payload)."""
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    names = [f.split()[0] for f in kind.split(", ")]
    schema = pa.schema([pa.field(k, t) for k, t in zip(names, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()])])

    @lean
    def task(batches):
        from pyarrow import fs

        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_file(at) as f:
                    data = f.read()
                held = []
                for r in read(data):
                    held.append({k: r[k] for k in names})
                    if len(held) >= 5000 or payloads and len(held) >= 200:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema)

    # a task for each file, as far as that many tasks make sense
    tasks = max(1, min(files.count(), MOST_TASKS))
    return files.select("path").repartition(tasks, "path").mapInArrow(task, kind)


def round_trip(pages: DataFrame, least: int = 0, **named) -> DataFrame:
    """Write the archives below the shared folder and read them back."""
    spark = pages.sparkSession
    folder = f"{as_uri(checkpoint_root(spark))}/tessera/warc-{uuid.uuid4().hex}"
    files = write(pages, folder, least=least, **named)
    temporary(spark, folder)
    return load(files).drop("url")
