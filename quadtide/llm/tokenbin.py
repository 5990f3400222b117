"""Token ids in packed binary files: best-fit-decreasing by a segment tree over free capacities.

Documents are tokenised whole, an end id is added, and only those over the row length are cut, in
pieces that together give every id back. Documents are packed where they are read: each task turns
every FILE_DOCS documents (or FILE_BYTES of ids) of its own into a file in the shared folder, so no
token is shuffled, and a file wastes less than a row on average:

    magic, version, rows, row length, pieces, bytes of an id      (6 little-endian 64-bit integers)
    ids          rows x row length, unsigned; what is left of a row is the pad id
    cu_seqlens   for each row 0 and the cumulative lengths of its pieces (int32), rows one after another
    row_starts   where each row's part of cu_seqlens begins (int64, rows + 1)
    resets       rows x row length bits, each row in whole bytes, the first bit uppermost: 1 where
                 position ids restart at 0, so at the start of each piece and of the padding
    pieces       for each piece in file order: doc_id, piece, start (int64)

Ids take 16 bits where the vocabulary's largest id, the end id and the pad id allow it, else 32; an id
that a file's width can't hold is an error. A file's name holds a fresh random part, and only the
names that the written manifest holds are read: a task that is run again, or twice at once, leaves a
file that nobody reads.

Defined cases: a null or empty text is the end id alone; a null doc_id is written as the least
64-bit integer and read back as null; repeated rows are pieces of their own; an empty table has no files.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bestfit import best_fit_decreasing
from .common import filesystem, materialize, prepare, scratch
from .tokens import ids_of, largest_id

ROW = 2048
#: A file is closed at so many documents or bytes of ids.
FILE_DOCS, FILE_BYTES = 8192, 64 << 20
MAGIC, VERSION = 0x51544B53, 2
_NULL = np.iinfo(np.int64).min
_HEADER = 6


def write_file(path: str, doc: np.ndarray, piece: np.ndarray, start: np.ndarray, ids: list[bytes], row_length: int, wide: bool, pad_id: int = 0) -> tuple[int, int]:
    """Packs pieces (ids: integers of 32 bits if wide, else 16) into rows and writes the file; (rows, bytes)."""
    kind = "<u4" if wide else "<u2"
    if pad_id >> (8 * np.dtype(kind).itemsize):
        raise ValueError(f"the pad id {pad_id} needs more than {8 * np.dtype(kind).itemsize} bits")
    lengths = np.array([len(x) for x in ids], np.int64) // np.dtype(kind).itemsize
    rows_of, rows = best_fit_decreasing(lengths, row_length)
    order = np.argsort(rows_of, kind="stable")
    matrix, resets = np.full((rows, row_length), pad_id, kind), np.zeros((rows, row_length + 1), bool)
    cu: list[int] = []
    row_starts = [0]
    last, at = -1, 0
    for k in order.tolist():
        if rows_of[k] != last:
            if last >= 0:
                row_starts.append(len(cu))
            last, at = int(rows_of[k]), 0
            cu.append(0)
        n = int(lengths[k])
        matrix[last, at: at + n] = np.frombuffer(ids[k], kind)
        resets[last, at] = True
        at += n
        resets[last, at] = True  # what follows, or the padding
        cu.append(at)
    row_starts.append(len(cu))
    header = np.array([MAGIC, VERSION, rows, row_length, len(ids), 4 if wide else 2], "<i8")
    blob = b"".join([header.tobytes(), matrix.tobytes(), np.array(row_starts, "<i8").tobytes(), np.array(cu, "<i4").tobytes(), np.packbits(resets[:, :row_length], axis=1).tobytes(), np.stack([doc[order], piece[order], start[order]]).astype("<i8").tobytes()])
    fs, name = filesystem(path)
    fs.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(name) as f:
        f.write(blob)
    return rows, len(blob)


class TokenFile:
    """One packed file: ids, cu_seqlens, positions and the pieces' origins."""

    def __init__(self, path: str):
        fs, name = filesystem(path)
        with fs.open_input_file(name) as f:
            raw = f.read()
        magic, version, self.rows, self.row_length, self.pieces, width = np.frombuffer(raw, "<i8", _HEADER).tolist()
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{path} isn't a packed token file")
        at = 8 * _HEADER
        self.ids = np.frombuffer(raw, "<u2" if width == 2 else "<u4", self.rows * self.row_length, at).reshape(self.rows, self.row_length)
        at += width * self.rows * self.row_length
        self.row_starts = np.frombuffer(raw, "<i8", self.rows + 1, at)
        at += 8 * (self.rows + 1)
        self.cu = np.frombuffer(raw, "<i4", int(self.row_starts[-1]), at)
        at += 4 * len(self.cu)
        wide = -(-self.row_length // 8)
        self.resets = np.unpackbits(np.frombuffer(raw, np.uint8, self.rows * wide, at).reshape(self.rows, wide), axis=1, count=self.row_length).astype(bool)
        at += self.rows * wide
        self.origin = np.frombuffer(raw, "<i8", 3 * self.pieces, at).reshape(3, self.pieces)

    def cu_seqlens(self, row: int) -> np.ndarray:
        return self.cu[self.row_starts[row]: self.row_starts[row + 1]]

    def positions(self, row: int) -> np.ndarray:
        """Position ids of a row by its resets: from 0 in every piece, and from 0 in the padding."""
        at = np.arange(self.row_length)
        return at - np.maximum.accumulate(np.where(self.resets[row], at, 0))

    def segments(self):
        """(doc_id, piece, start, row, offset, ids) of each piece in file order."""
        k = 0
        for row in range(self.rows):
            cu = self.cu_seqlens(row)
            for lo, hi in zip(cu[:-1].tolist(), cu[1:].tolist()):
                doc, piece, start = self.origin[:, k].tolist()
                yield (None if doc == _NULL else doc), piece, start, row, lo, self.ids[row, lo:hi]
                k += 1


class _Pieces:
    """Pieces that wait for their file."""

    def __init__(self):
        self.doc, self.piece, self.start, self.ids = [], [], [], []
        self.docs = self.bytes = 0

    def add(self, doc: int | None, raw: bytes, row_length: int, kind: str) -> None:
        """All ids of a document, as 32-bit integers, cut into pieces."""
        for piece, start in enumerate(range(0, len(raw) // 4, row_length)):
            part = np.frombuffer(raw[4 * start: 4 * (start + row_length)], "<u4")
            if kind == "<u2":
                if part.max() > 0xFFFF:
                    raise ValueError(f"id {part.max()} needs more than 16 bits: write with wide=True")
                part = part.astype(kind)
            part = part.tobytes()
            self.doc.append(_NULL if doc is None else doc), self.piece.append(piece), self.start.append(start), self.ids.append(part)
            self.bytes += len(part)
        self.docs += 1

    def write(self, name: str, row_length: int, wide: bool, pad_id: int) -> tuple[str, int, int, int]:
        rows, size = write_file(name, np.array(self.doc, np.int64), np.array(self.piece, np.int64), np.array(self.start, np.int64), self.ids, row_length, wide, pad_id)
        return name, rows, len(self.ids), size


def write(docs: DataFrame, path: str, tokenizer: str, row_length: int = ROW, end_id: int = 0, file_docs: int = FILE_DOCS, wide: bool | None = None, pad_id: int = 0) -> DataFrame:
    """Writes packed files under path; the manifest (file, rows, pieces, bytes), itself a written table.

    wide: ids of 32 bits; None takes them where the vocabulary needs them."""
    prepare(docs.sparkSession)
    if wide is None:
        wide = max(largest_id(tokenizer), end_id, pad_id) > 0xFFFF
    kind = "<u4" if wide else "<u2"

    def apply(batches):
        from pyspark import TaskContext

        part, done, held = TaskContext.get().partitionId(), [], _Pieces()

        def close() -> None:
            nonlocal held
            done.append(held.write(f"{path}/tokens-{part:06d}-{len(done):04d}-{uuid.uuid4().hex}.bin", row_length, wide, pad_id))
            held = _Pieces()

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                held.add(doc, ids_of(text, tokenizer) + int(end_id).to_bytes(4, "little"), row_length, kind)
                if held.docs >= file_docs or held.bytes >= FILE_BYTES:
                    close()
        if held.docs:
            close()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(kinds)], ["file", "rows", "pieces", "bytes"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(texts.mapInArrow(apply, "file string, rows long, pieces long, bytes long"), "tokens-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """A row for each piece in the manifest's files: doc_id, piece, start, length, ids_crc32, file, row, offset."""
    n = max(1, manifest.count())

    def apply(batches):
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "file", "row", "offset"]
        for b in batches:
            for file in b.column("file").to_pylist():
                rows: list[list] = [[] for _ in names]
                for doc, piece, start, row, offset, ids in TokenFile(file).segments():
                    for col, v in zip(rows, (doc, piece, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), file.rsplit("/", 1)[1], row, offset)):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names)

    files = manifest.select("file").repartition(min(n, 50_000))
    return files.mapInArrow(apply, "doc_id long, piece int, start long, length long, ids_crc32 long, file string, row long, offset long")


def write_and_read(docs: DataFrame, tokenizer: str, row_length: int = ROW) -> DataFrame:
    """Writes the packed files into the shared folder and returns what they hold."""
    return read(write(docs, scratch(docs.sparkSession, "tokens"), tokenizer, row_length)).withColumn("file", F.regexp_extract("file", r"^tokens-\d+-\d+", 0))
