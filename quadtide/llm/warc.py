"""WARC records in ZIP packages, read by range without extraction.

Writing: a package is a ZIP archive (with ZIP64 records where needed) of two stored members,
`archive/data.warc.gz`, one gzip member for each WARC record, and `indexes/index.cdx`, one line for
each record with its place in the archive member. Each task writes its rows to packages of bounded
size in the shared folder; a name has a fresh random part, and only the names in the written
manifest are read, so a task that runs twice does no harm.

Reading: the end-of-central-directory record (and the ZIP64 one where it is needed) leads to the
central directory, that to the members' local headers, and those to the first byte of a stored
member. The index member then gives the range of each record, which is read and decompressed on its
own, neighbouring ranges in one read.

Of records with equal payloads of at least min_revisit bytes, that with the smallest id is a
response and the others are revisits that refer to it; shorter payloads are all responses.

Defined cases: a null payload is empty; rows with a null id are written with no id, are never
referred to while a row with an id has the payload, and revisit that row (without one they are
responses); repeated rows with the smallest id are all responses; a null url is written as the
record's own URN.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import attach_group_min, filesystem, materialize, prepare, scratch

#: A package is closed when its archive member has so many bytes.
PACKAGE_BYTES = 32 << 20
#: Bytes fetched with one read at most, but for a longer record.
READ_BYTES = 4 << 20
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2024-01-01T00:00:00Z"


# --- ZIP -------------------------------------------------------------------------------------------

class ZipWriter:
    """Stored members written one after another; ZIP64 records where sizes or offsets need them."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.force = out, 0, [], zip64

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def member(self, name: str, chunks: list[bytes]) -> None:
        size, crc = sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        raw, start = name.encode(), self.at
        big = self.force or size >= 0xFFFFFFFF
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        short = 0xFFFFFFFF if big else size
        self._write(struct.pack("<4s5H3L2H", b"PK\3\4", 45 if big else 20, 0x800, 0, 0, 0x21, crc, short, short, len(raw), len(extra)) + raw + extra)
        for c in chunks:
            self._write(c)
        self.members.append((raw, crc, size, start))

    def close(self) -> None:
        begin = self.at
        for raw, crc, size, start in self.members:
            extra = b""
            short = [size, start]
            wide = [(k, v) for k, v in enumerate((size, size, start)) if self.force or v >= 0xFFFFFFFF]
            if wide:
                extra = struct.pack(f"<HH{len(wide)}Q", 1, 8 * len(wide), *(v for _, v in wide))
                short = [0xFFFFFFFF if any(k == 0 for k, _ in wide) else size, 0xFFFFFFFF if any(k == 2 for k, _ in wide) else start]
            self._write(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45 if wide else 20, 0x800, 0, 0, 0x21, crc, short[0], short[0], len(raw), len(extra), 0, 0, 0, 0, short[1]) + raw + extra)
        size, n = self.at - begin, len(self.members)
        if self.force or n >= 0xFFFF or size >= 0xFFFFFFFF or begin >= 0xFFFFFFFF:
            end = self.at
            self._write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, begin))
            self._write(struct.pack("<4sLQL", b"PK\6\7", 0, end, 1))
            n, size, begin = 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF
        self._write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, size, begin, 0))


class ZipPackage:
    """The central directory of a ZIP archive and ranges of its stored members. file: a seekable
    binary file; nothing but the directory and the asked ranges is read."""

    def __init__(self, file):
        self.file = file
        file.seek(0, 2)
        self.size = file.tell()
        tail_at = max(0, self.size - (1 << 16) - 22)
        tail = self._read(tail_at, self.size - tail_at)
        k = len(tail) - 22
        while k >= 0 and not (tail[k:k + 4] == b"PK\5\6" and k + 22 + struct.unpack_from("<H", tail, k + 20)[0] == len(tail)):
            k = tail.rfind(b"PK\5\6", 0, k + 3)
        if k < 0:
            raise ValueError("not a ZIP archive: no end of central directory")
        n, size, begin = struct.unpack_from("<H2L", tail, k + 10)
        if n == 0xFFFF or size == 0xFFFFFFFF or begin == 0xFFFFFFFF:
            locator = self._read(tail_at + k - 20, 20) if tail_at + k >= 20 else b""
            if locator[:4] != b"PK\6\7":
                raise ValueError("ZIP64 locator is missing")
            record = self._read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("ZIP64 end of central directory is missing")
            n, size, begin = struct.unpack_from("<3Q", record, 32)
        self.members: dict[str, tuple[int, int, int, int]] = {}  # method, stored size, size, local header
        directory, at = self._read(begin, size), 0
        for _ in range(n):
            if directory[at:at + 4] != b"PK\1\2":
                raise ValueError("the central directory is damaged")
            method = struct.unpack_from("<H", directory, at + 10)[0]
            packed, full = struct.unpack_from("<2L", directory, at + 20)
            names, extras, comment = struct.unpack_from("<3H", directory, at + 28)
            start = struct.unpack_from("<L", directory, at + 42)[0]
            name = directory[at + 46: at + 46 + names].decode("utf-8", "replace")
            extra, e = directory[at + 46 + names: at + 46 + names + extras], 0
            while e + 4 <= len(extra):
                kind, length = struct.unpack_from("<2H", extra, e)
                if kind == 1:  # ZIP64: only the values that didn't fit, in this order
                    values = iter(struct.unpack_from(f"<{length // 8}Q", extra, e + 4))
                    full = next(values) if full == 0xFFFFFFFF else full
                    packed = next(values) if packed == 0xFFFFFFFF else packed
                    start = next(values) if start == 0xFFFFFFFF else start
                e += 4 + length
            self.members[name] = (method, packed, full, start)
            at += 46 + names + extras + comment

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def begin(self, name: str) -> int:
        """Where a stored member's first byte is."""
        method, _, _, start = self.members[name]
        if method:
            raise ValueError(f"{name} isn't stored: its bytes can't be read by range")
        header = self._read(start, 30)
        if header[:4] != b"PK\3\4":
            raise ValueError(f"{name} has no local header")
        return start + 30 + sum(struct.unpack_from("<2H", header, 26))

    def read(self, name: str, at: int = 0, n: int | None = None) -> bytes:
        """Bytes of a stored member."""
        full = self.members[name][2]
        n = full - at if n is None else min(n, full - at)
        return self._read(self.begin(name) + at, n)


# --- WARC ------------------------------------------------------------------------------------------

def record_urn(page_id: int | None, salt: str = "") -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{salt}')}"


def make_record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, refers_to: int | None, size: int) -> bytes:
    """One WARC record; a revisit has the HTTP header alone, which tells the payload's size."""
    urn = record_urn(page_id)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{urn}>", f"WARC-Date: {DATE}"]
    lines.append(f"WARC-Target-URI: {quote(url, safe=_SAFE) if url else urn}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_urn(refers_to)}>", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127))  # only controls, blanks and what isn't ASCII are escaped


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and the block of one WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return fields, rest[: int(fields["content-length"])]


def http_payload(block: bytes) -> tuple[int, bytes]:
    """The announced payload length and the payload that is there."""
    head, _, body = block.partition(b"\r\n\r\n")
    for line in head.split(b"\r\n"):
        if line.lower().startswith(b"content-length:"):
            return int(line.split(b":")[1]), body
    return len(body), body


def _digest(payload: bytes) -> str:
    return _base32(hashlib.sha1(payload).digest())


def _base32(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


class _Package:
    """An open package: records are gathered, then written with their index."""

    def __init__(self):
        self.chunks, self.index, self.at = [], [], 0

    def add(self, raw: bytes, page_id: int | None) -> None:
        packed = _gzip(raw)
        self.index.append(json.dumps({"page": page_id, "offset": self.at, "length": len(packed)}))
        self.chunks.append(packed)
        self.at += len(packed)

    def write(self, folder: str) -> tuple[str, int]:
        name = f"{folder}/pages-{uuid.uuid4().hex}.wacz"
        fs, path = filesystem(name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            z = ZipWriter(out)
            z.member(ARCHIVE, self.chunks)
            z.member(INDEX, ["\n".join(self.index).encode()])
            z.close()
        return name, len(self.index)


def _gzip(raw: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


#: Revisits whose keys are broadcast, at most (about 30 MB).
BROADCAST_KEYS = 500_000


def _responses(pages: DataFrame, revisits: DataFrame) -> DataFrame:
    """The pages that are no revisits, with their payloads, in the partitions that they are read in: the
    keys of revisits are broadcast if they are few. Else a Bloom filter of bounded size lets most pages
    through, and only those that it holds are shuffled and compared with the keys; with more revisits than
    the filter is good for all pages are."""
    keys = ["nameless", "id", "sha1"]
    known = revisits.select(*keys).distinct()
    many = known.count()
    if many <= BROADCAST_KEYS:
        return pages.join(F.broadcast(known), keys, "left_anti")
    if many > bloom.BITS // 8:
        return pages.join(known, keys, "left_anti")
    hashed = pages.withColumn("hash", F.xxhash64(*keys))
    table = pages.sparkSession.sparkContext.broadcast(bloom.build(known.select(F.xxhash64(*keys).alias("hash")), many))

    def sift(held: bool):
        def apply(batches):
            for b in batches:
                there = bloom.holds(table.value, b.column("hash").to_numpy(zero_copy_only=False))
                yield b.filter(pa.array(there == held))
        return apply

    free, maybe = (hashed.mapInArrow(sift(held), hashed.schema).drop("hash") for held in (False, True))
    return free.unionByName(maybe.join(known, keys, "left_anti").select(*pages.columns))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit: int = 0) -> DataFrame:
    """Writes a record for each row into packages under folder; the manifest (file, records), a written table.

    Which rows are revisits is decided on ids, sizes and digests; a revisit's record needs no more, so
    payloads are read where they lie and written from there."""
    prepare(pages.sparkSession)
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), body.alias("payload"))
    pages = pages.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("nameless", F.col("page_id").isNull()).withColumn("id", F.coalesce("page_id", F.lit(0)))
    facts = materialize(pages.select("page_id", "url", "nameless", "id", "sha1", F.octet_length("payload").cast("long").alias("size")), "warc-facts")
    origin = attach_group_min(facts.where(F.col("size") >= min_revisit), ["sha1"], "page_id", "origin")
    revisits = materialize(origin.where("origin IS NOT NULL AND NOT page_id <=> origin"), "warc-revisits")
    responses = _responses(pages, revisits).select("page_id", "url", "payload", "sha1", F.lit(None).cast("long").alias("origin"), F.octet_length("payload").cast("long").alias("size"))
    rows = responses.unionByName(revisits.select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "sha1", "origin", "size"))

    def apply(batches):
        package = _Package()
        done = []
        for b in batches:
            for page, url, payload, sha1, origin, size in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha1", "origin", "size"))):
                package.add(make_record(page, url, payload, _base32(sha1), origin, size), page)
                if package.at >= PACKAGE_BYTES:
                    done.append(package.write(folder))
                    package = _Package()
        if package.index:
            done.append(package.write(folder))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["file", "records"])

    return materialize(rows.mapInArrow(apply, "file string, records long"), "warc-manifest")


def _tasks(manifest: DataFrame) -> int:
    """A task for each package, within bounds."""
    return min(max(manifest.count(), 16), 50_000)


def locate(manifest: DataFrame) -> DataFrame:
    """file, at, lengths: ranges of neighbouring records, of at most about READ_BYTES, from each package's index."""

    def apply(batches):
        for b in batches:
            out: list[tuple[str, int, list[int]]] = []
            for file in b.column("file").to_pylist():
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    z = ZipPackage(f)
                    base = z.begin(ARCHIVE)
                    at, n, lengths = 0, 0, []
                    for line in z.read(INDEX).decode().split("\n"):
                        entry = json.loads(line)
                        if n and n + entry["length"] > READ_BYTES:
                            out.append((file, base + at, lengths))
                            at, n, lengths = entry["offset"], 0, []
                        n += entry["length"]
                        lengths.append(entry["length"])
                    out.append((file, base + at, lengths))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))], ["file", "at", "lengths"])

    return manifest.select("file").repartition(_tasks(manifest)).mapInArrow(apply, "file string, at long, lengths array<long>")


def read(manifest: DataFrame, content: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of each record, read from the
    packages by range; content: also url and payload (null for revisits)."""
    prepare(manifest.sparkSession)
    ranges = locate(manifest).repartition(_tasks(manifest), "file", "at")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", url string, payload binary" if content else "")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + ([pa.string(), pa.binary()] if content else [])
    names = [c.split()[0] for c in schema.split(", ")]

    def apply(batches):
        for b in batches:
            for file, at, lengths in zip(*(b.column(c).to_pylist() for c in ("file", "at", "lengths"))):
                fs, path = filesystem(file)
                with fs.open_input_file(path) as f:
                    f.seek(at)
                    raw = f.read(sum(lengths))
                rows, begin = [], 0
                for n in lengths:
                    fields, block = parse_record(zlib.decompress(raw[begin: begin + n], 31))
                    begin += n
                    size, payload = http_payload(block)
                    kind, digest = fields["warc-type"], fields["warc-payload-digest"].partition(":")[2]
                    if kind == "response":
                        if _digest(payload) != digest or len(payload) != size:
                            raise ValueError(f"the payload of {fields['warc-record-id']} in {file} doesn't have its digest")
                    page = int(fields["x-page"]) if "x-page" in fields else None
                    origin = int(fields["x-refers-to-page"]) if "x-refers-to-page" in fields else None
                    row = (page, size, digest, kind, origin)
                    rows.append(row + ((fields["warc-target-uri"], payload if kind == "response" else None) if content else ()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return ranges.mapInArrow(apply, schema)


def write_and_read(pages: DataFrame, min_revisit: int = 0) -> DataFrame:
    """Writes packages into the shared folder and returns what their records say."""
    return read(write(pages, scratch(pages.sparkSession, "warc"), min_revisit=min_revisit))
