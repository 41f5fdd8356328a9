"""Legacy archive converter: ARC files, versions 1 and 2, to WARC 1.0.

An ARC file opens with a ``filedesc:`` record whose block names the version; that decides which fields a record's header
line has. The declared length delimits the block. Plain files and files of gzip members are read, as streams: memory
follows one record. The converter makes what ARC lacks: a record id (a name-based UUID of file and offset), an ISO
timestamp, the type and SHA-1 digests. Records with equal payloads of at least ``LEAST`` bytes become revisits of the one
with the largest key; which those are is found over a narrow index (file, offset, key, digest, length), so payloads never
travel. Files go below the shared folder through ``pyarrow.fs``, under names given by the partition, and are moved into
place when complete: a task that runs again writes the same file.

Null html is an empty payload, a null url is ``urn:none``. A null ``page_id`` is written without a key and is a response
unless an equal payload has a key. Rows with one key and payload: one is the response, the others revisit it. An empty
table gives no file and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch

LEAST = 1000
ROTATE = 256 << 20  # bytes of an archive before the next is begun
KEY = "X-Page-Id"
# Fixed values of the two formats.
FIELDS = {
    1: ["url", "ip", "date", "type", "length"],
    2: ["url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length"],
}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    block: bytes


def open_in(path: str):
    fs, name = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(name)


class Output:
    """A file that appears under its name only when closed."""

    def __init__(self, path: str):
        self.fs, self.name = pafs.FileSystem.from_uri(path)
        self.fs.create_dir(self.name.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part)
        self.size = 0

    def member(self, data: bytes) -> None:
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        data = z.compress(data) + z.flush()
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.part, self.name)


def members(f, at: int = 0) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member from ``at`` on."""
    f.seek(at)
    held = b""
    while held or (held := f.read(1 << 16)):
        z, out, start, used = zlib.decompressobj(31), [], at, 0
        while True:
            out.append(z.decompress(held))
            used += len(held)
            if z.eof:
                held = z.unused_data
                break
            held = f.read(1 << 16)
            if not held:
                raise ValueError(f"gzip member at {start} is cut off")
        at += used - len(held)
        yield start, b"".join(out)


def _arc_line(line: bytes, version: int) -> dict[str, str]:
    names = FIELDS[version]
    parts = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)  # a url may hold spaces
    if len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not a header line of ARC version {version}: {line[:200]!r}")
    return dict(zip(names, parts))


def _arc_block(source, size: int) -> bytes:
    block = source.read(size)
    if len(block) != size:
        raise ValueError(f"record declares {size} bytes and has {len(block)}")
    return block


def arc_records(f) -> Iterator[ArcRecord]:
    """The records of an ARC file after its version block, from its start."""
    f.seek(0)
    packed = f.read(2) == b"\x1f\x8b"
    f.seek(0)
    version = 0
    if packed:
        for at, data in members(f):
            record, version = _read_arc(io.BytesIO(data), at, version)
            if record:
                yield record
    else:
        source = io.BufferedReader(f) if not isinstance(f, io.BytesIO) else f
        while True:
            at = source.tell()
            record, version = _read_arc(source, at, version)
            if record is None and version < 0:
                return
            if record:
                yield record


def _read_arc(source, at: int, version: int) -> tuple[ArcRecord | None, int]:
    """The next record (None: the version block) and the version; a negative version at the end."""
    line = source.readline()
    while line in (b"\n", b"\r\n"):
        line = source.readline()
    if not line:
        return None, -1
    line = line.rstrip(b"\r\n")
    if not version:
        if not line.startswith(b"filedesc:"):
            raise ValueError(f"an ARC file begins with filedesc:, not {line[:80]!r}")
        block = _arc_block(source, int(line.rsplit(b" ", 1)[1]))
        version = int(block.split(b" ", 1)[0])
        if version not in FIELDS:
            raise ValueError(f"ARC version {version}")
        return None, version
    fields = _arc_line(line, version)
    return ArcRecord(at, fields, _arc_block(source, int(fields["length"]))), version


def http_parts(block: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head (with its blank line), header fields in lower case, and payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return head + gap, fields, payload


def arc_version_block(name: str, version: int, date: str) -> bytes:
    block = f"{version} 0 quillgraph\n{TITLES[version]}\n".encode()
    rest = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{rest} {len(block)}\n".encode() + block + b"\n"


def arc_member(url: str, date: str, block: bytes, version: int, name: str, offset: int) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) or "urn:none"
    rest = "" if version == 1 else f" 200 {hashlib.md5(block).hexdigest()} - {offset} {name}"
    return f"{url} 0.0.0.0 {date} text/html{rest} {len(block)}\n".encode() + block + b"\n"


def record_id(file: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}>"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def warc_from_arc(arc: ArcRecord, file: str, refers_to: str | None = None, refers_uri: str | None = None) -> bytes:
    """The WARC record of an ARC record: a response, or a revisit that keeps the HTTP head alone."""
    head, _, payload = http_parts(arc.block)
    d = arc.fields["date"].ljust(14, "0")
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    block = head if refers_to else arc.block
    fields = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", record_id(file, arc.offset)), ("WARC-Date", date),
              ("WARC-Target-URI", arc.fields["url"]), ("WARC-IP-Address", arc.fields["ip"]), ("WARC-Payload-Digest", base32(hashlib.sha1(payload).digest())),
              ("WARC-Block-Digest", base32(hashlib.sha1(block).digest())), ("Content-Type", "application/http; msgtype=response")]
    if refers_to:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", refers_to), *([("WARC-Refers-To-Target-URI", refers_uri)] if refers_uri else [])]
    return warc_record(fields, block)


def read_warc(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower case) and block of each record of a WARC file of gzip members."""
    for at, data in members(f):
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(fields["content-length"])
        if len(rest) < size:
            raise ValueError(f"record at {at} declares {size} bytes and has {len(rest)}")
        yield fields, rest[:size]


def _write_arc(root: str, date: str):
    def run(batches):
        part, n, out, file, version = TaskContext.get().partitionId(), 0, None, "", 1
        for batch in batches:
            for page, url, html in zip(*(batch.column(i) for i in range(3))):
                if out is None:
                    version, file = 1 + (part + n) % 2, f"{root}/part-{part:06d}-{n:04d}.arc.gz"
                    out = Output(file)
                    out.member(arc_version_block(file.rsplit("/", 1)[1], version, date))
                payload = (html.as_py() or "").encode()
                key = f"{KEY}: {page.as_py()}\r\n" if page.is_valid else ""
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
                out.member(arc_member(url.as_py() or "", date, block, version, file.rsplit("/", 1)[1], out.size))
                if out.size >= ROTATE:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"file": [file]})
                    out, n = None, n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [file]})

    return run


def _index(batches):
    for batch in batches:
        for file in batch.column(0).to_pylist():
            rows = []
            with open_in(file) as f:
                for r in arc_records(f):
                    _, fields, payload = http_parts(r.block)
                    key = fields.get(KEY.lower())
                    rows.append((file, r.offset, int(key) if key else None, hashlib.sha1(payload).hexdigest(), len(payload), r.fields["url"]))
                    if len(rows) >= 10_000:
                        yield _rows(rows)
                        rows = []
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["file", "offset", "key", "digest", "size", "url"])


def _convert(root: str):
    """Rows (file, offset, refers_file, refers_offset, refers_url) sorted by file and offset."""

    def run(batches):
        file, out, source, held, target = None, None, None, None, ""
        for batch in batches:
            for name, offset, rfile, roffset, rurl in zip(*(c.to_pylist() for c in batch.columns)):
                if name != file:
                    if out is not None:
                        out.close()
                        held.close()
                        yield pa.RecordBatch.from_pydict({"file": [target]})
                    file, target = name, root + "/" + re.sub(r"\.arc(\.gz)?$", "", name.rsplit("/", 1)[1]) + ".warc.gz"
                    held = open_in(name)
                    out, source = Output(target), arc_records(held)
                arc = next(source)
                while arc.offset < offset:
                    arc = next(source)
                out.member(warc_from_arc(arc, name, record_id(rfile, roffset) if rfile else None, rurl))
        if out is not None:
            out.close()
            held.close()
            yield pa.RecordBatch.from_pydict({"file": [target]})

    return run


def convert(arcs: DataFrame, root: str, store: Scratch) -> DataFrame:
    """Writes a WARC file below ``root`` for each ARC in ``arcs(file)``; gives the new files."""
    n = max(1, arcs.count())
    index = store.put("index", arcs.repartition(n, "file").mapInArrow(_index, "file string, offset long, key long, digest string, size long, url string"))
    first = (index.filter((F.col("size") >= LEAST) & F.col("key").isNotNull()).groupBy("digest")
             .agg(F.max(F.struct("key", "file", "offset", "url")).alias("r"), F.count("*").alias("n")))
    first = first.select("digest", F.col("r.file").alias("rfile"), F.col("r.offset").alias("roffset"), F.col("r.url").alias("rurl"))
    many = index.filter(F.col("size") >= LEAST).groupBy("digest").count().filter("count > 1").join(first, "digest").drop("count")
    # only records of at least LEAST bytes have a digest to join on
    big = index.filter(F.col("size") >= LEAST).select("file", "offset", "digest").join(many, "digest", "left")
    small = index.filter(F.col("size") < LEAST).select("file", "offset", *(F.lit(None).cast(k).alias(c) for c, k in (("rfile", "string"), ("roffset", "long"), ("rurl", "string"))))
    plan = big.select(*small.columns).unionByName(small)
    own = (F.col("rfile") == F.col("file")) & (F.col("roffset") == F.col("offset"))
    plan = plan.select("file", "offset", *(F.when(~own, F.col(c)).alias(c) for c in ("rfile", "roffset", "rurl")))
    return store.put("warcs", plan.repartition(n, "file").sortWithinPartitions("file", "offset").mapInArrow(_convert(root), "file string"))


def _read(batches):
    for batch in batches:
        for file in batch.column(0).to_pylist():
            rows = []
            with open_in(file) as f:
                for fields, block in read_warc(f):
                    _, http, payload = http_parts(block)
                    told = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and hashlib.sha1(payload).hexdigest() != told:
                        raise ValueError(f"{file}: payload of {fields['warc-record-id']} differs from its digest")
                    key = http.get(KEY.lower())
                    rows.append((int(key) if key else None, int(http["content-length"]) if revisit else len(payload), told, fields["warc-type"], fields["warc-record-id"], fields.get("warc-refers-to")))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 6, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "id", "ref"])


def archive_pages(pages: DataFrame, date: str = "20240101000000") -> DataFrame:
    """Pages through ARC and WARC files and back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    store = Scratch(pages.sparkSession)
    root = store.path("archives")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    root = root if "://" in root else "file://" + root if root.startswith("/") else re.sub(r"^file:/(?!/)", "file:///", root)
    arcs = store.put("arcs", pages.mapInArrow(_write_arc(root + "/arc", date), "file string"))
    warcs = convert(arcs, root + "/warc", store)
    store.drop("archives/arc")
    back = store.put("back", warcs.repartition(max(1, warcs.count()), "file").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, id string, ref string"))
    named = back.filter("ref is not null").select("ref").distinct().join(back.select(F.col("id").alias("ref"), F.col("page_id").alias("refers_to")), "ref")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    revisits = back.filter("ref is not null").join(named, "ref", "left").select(*out)
    return revisits.unionByName(back.filter("ref is null").withColumn("refers_to", F.lit(None).cast("long")).select(*out))
