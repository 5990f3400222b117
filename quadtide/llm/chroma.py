"""Audio fingerprints of a media column: integral-image filters over pitch-class frames.

A recording (WAV bytes, PCM of 8, 16, 24 or 32 bits) becomes mono at a fixed rate; the spectrum of
each frame is folded into 12 pitch classes, which go round the octave. An integral image over (frame,
pitch class) gives the sum of any rectangle with four reads, so each of 16 filters compares two groups
of rectangles in a window of frames; its log ratio is cut into four levels, two Gray-coded bits, and
the 16 levels of a window are packed into a 32-bit integer. The cuts are each filter's quartiles over
music that this module makes up with a fixed seed, so every level is as likely as any other and
unrelated recordings differ in about half of their bits. Two recordings are aligned by the histogram
of the offsets at which they have equal integers; the share of differing bits over the overlap at the
best offset is the bit error, and all offsets that tie are tried.

Silent windows have an integer of their own. It says nothing, so it is never looked up, and windows
that are silent on both sides count neither for the overlap nor for the bit error.

Search: queries against all recordings. Equal fingerprints are a class, and classes are compared
through their smallest ids. Recordings go in blocks of a bounded number of integers; each block of
queries meets each block of recordings, whose integers are sorted, so that every pair that shares an
integer is aligned: the result is that of aligning all pairs, whatever the lengths.

Defined cases: null, empty or unreadable media, and recordings too short for one window, have an
empty fingerprint, are their own class and match nothing; wholly silent recordings of equal length are
a class and match nothing else; a null id is kept without matches.
"""

from __future__ import annotations

import io
import struct
import wave
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach_group_min, materialize, prepare

RATE, FRAME, HOP, WINDOW = 4000, 512, 128, 16
#: A match: at most so large a share of differing bits, over at least so large a share of the shorter one.
MOST_ERROR, LEAST_OVERLAP = 0.2, 0.5
_LOW, _HIGH = 60.0, 1900.0


def decode_wav(media: bytes | None) -> np.ndarray:
    """Mono samples in -1..1 at RATE; nothing if the bytes aren't such a file."""
    if not media:
        return np.zeros(0)
    try:
        with wave.open(io.BytesIO(media)) as w:
            channels, width, rate = w.getnchannels(), w.getsampwidth(), w.getframerate()
            raw = w.readframes(w.getnframes())
    except (wave.Error, EOFError, struct.error):
        return np.zeros(0)
    if width not in (1, 2, 3, 4) or not channels or not rate:
        return np.zeros(0)
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 1:
        x = np.frombuffer(raw, np.uint8) / 128 - 1.0
    elif width == 3:  # the upper bytes of 32-bit integers
        x = np.zeros((len(raw) // 3, 4), np.uint8)
        x[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = x.reshape(-1).view("<i4") / 2**31
    else:
        x = np.frombuffer(raw, f"<i{width}") / 2.0 ** (8 * width - 1)
    x = x.reshape(-1, channels).mean(1)
    if rate > RATE and len(x):
        x = _low_pass(x, RATE / rate)
    if rate != RATE and len(x):
        x = np.interp(np.arange(0, len(x), rate / RATE), np.arange(len(x)), x)
    return x


def _low_pass(x: np.ndarray, share: float) -> np.ndarray:
    """Keeps about the lower `share` of the spectrum, by a windowed sinc, so that nothing folds back."""
    reach = int(16 / share)
    t = np.arange(-reach, reach + 1)
    taps = np.sinc(0.95 * share * t) * np.hanning(len(t) + 2)[1:-1]
    taps /= taps.sum()
    step = 1 << (len(taps) * 8).bit_length()  # overlap-add: memory for a block, not for the recording
    spectrum, out = np.fft.rfft(taps, step), np.zeros(len(x) + len(taps) - 1)
    block = step - len(taps) + 1
    for k in range(0, len(x), block):
        part = np.fft.irfft(np.fft.rfft(x[k: k + block], step) * spectrum, step)[: len(x[k: k + block]) + len(taps) - 1]
        out[k: k + len(part)] += part
    return out[reach: reach + len(x)]


def encode_wav(x: np.ndarray, rate: int = RATE) -> bytes:
    """A mono WAV file of 16 bits."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def _folding() -> np.ndarray:
    """Which pitch class the bins of a spectrum belong to, as a matrix; bins share by nearness."""
    freq = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(freq), 12))
    for k, f in enumerate(freq):
        if _LOW <= f <= _HIGH:
            tone = 12 * np.log2(f / 440.0) % 12
            lo, part = int(tone), tone % 1
            out[k, lo % 12] += 1 - part
            out[k, (lo + 1) % 12] += part
    return out


_FOLDING, _TAPER = _folding(), np.hanning(FRAME)


def chroma(x: np.ndarray) -> np.ndarray:
    """Pitch-class frames (frames x 12), each of unit length or silent."""
    n = (len(x) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:n] * _TAPER
    power = np.abs(np.fft.rfft(frames, axis=1)) ** 2 @ _FOLDING
    length = np.sqrt((power**2).sum(1, keepdims=True))
    return np.where(length > 1e-6, power / np.maximum(length, 1e-12), 0)


def _filters() -> list[tuple[int, int, int]]:
    """(kind, first pitch class, pitch classes) of the 16 filters, by rule."""
    return [(k % 4, 5 * k % 12, (2, 4, 6)[k % 3]) for k in range(16)]


FILTERS = _filters()


def responses(image: np.ndarray) -> np.ndarray:
    """What each filter says of each window of pitch-class frames (windows x 16)."""
    n = len(image) - WINDOW + 1
    if n < 1:
        return np.zeros((0, len(FILTERS)))
    area = np.zeros((24, len(image) + 1))
    area[1:, 1:] = np.concatenate([image, image[:, :11]], 1).T.cumsum(0).cumsum(1)

    def total(t: int, w: int, y: int, h: int) -> np.ndarray:
        strip = area[y + h] - area[y]
        return strip[t + w: t + w + n] - strip[t: t + n]

    half, third, out = WINDOW // 2, WINDOW // 3, np.zeros((n, len(FILTERS)))
    for k, (kind, y, h) in enumerate(FILTERS):
        whole = total(0, WINDOW, y, h)
        if kind == 0:  # later against earlier
            plus = total(half, half, y, h)
        elif kind == 1:  # upper against lower pitch classes
            plus = total(0, WINDOW, y + h // 2, h - h // 2)
        elif kind == 2:  # a chequer of four
            plus = total(0, half, y, h // 2) + total(half, half, y + h // 2, h - h // 2)
        else:  # the middle third of the time against the outer ones, which count half
            plus = 2 * total(third, WINDOW - 2 * third, y, h)
            whole = whole + plus / 2
        out[:, k] = (1 + plus) / (1 + np.maximum(whole - plus, 0))
    return np.log(out)


def _made_up(rng: np.random.Generator, seconds: float = 8.0) -> np.ndarray:
    """Music of one to three voices with notes of random pitch, length and loudness."""
    out = np.zeros(int(seconds * RATE))
    for _ in range(rng.integers(1, 4)):
        at = 0
        while at < len(out):
            n = int(rng.uniform(0.1, 0.6) * RATE)
            t = np.arange(min(n, len(out) - at)) / RATE
            tone = sum(np.sin(2 * np.pi * h * 110 * 2 ** (rng.integers(0, 37) / 12) * t) / h for h in (1, 2, 3))
            out[at: at + n] += rng.uniform(0.3, 1) * tone * np.hanning(n)[: len(t)] ** 0.25
            at += n
    return 0.2 * out


@lru_cache(maxsize=1)
def cuts(pieces: int = 60) -> np.ndarray:
    """The quartiles of each filter (3 x 16) over music made up with a fixed seed."""
    rng = np.random.default_rng(2024)
    return np.quantile(np.concatenate([responses(chroma(_made_up(rng))) for _ in range(pieces)]), (0.25, 0.5, 0.75), axis=0)


def _packed(levels: np.ndarray) -> np.ndarray:
    out = np.zeros(len(levels), np.uint32)
    for level in levels.T.astype(np.uint32):
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


#: The integer of a silent window; no other window has it.
SILENT = np.uint32(0xAAAAAAAA)


def fingerprint(x: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """A 32-bit integer for each window of WINDOW frames."""
    at, image = cuts() if at is None else at, chroma(x)
    said = responses(image)
    out = _packed(sum((said >= c).view(np.uint8) for c in at))
    out[out == SILENT] ^= np.uint32(1)
    if len(out):
        sounding = np.r_[0, image.any(1).cumsum()]
        out[sounding[WINDOW:] == sounding[: len(out)]] = SILENT
    return out


def align(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int] | None:
    """(offset, overlap, bit errors) at the offset with most equal integers: a[i] lies at b[i + offset].
    None without an equal integer. Ties go to the fewer bit errors a window, then the smaller offset."""
    found = align_all([a], [b])
    return tuple(found[0, 2:].tolist()) if len(found) else None


def sounding(f: np.ndarray) -> int:
    """Windows that aren't silent."""
    return int((f != SILENT).sum())


def accepts(a: np.ndarray, b: np.ndarray, found: tuple[int, int, int] | None) -> bool:
    return found is not None and found[1] >= LEAST_OVERLAP * min(sounding(a), sounding(b)) and found[2] <= MOST_ERROR * 32 * found[1]


#: Integers of a block of recordings, blocks that a task makes, equal integers looked at together, and integers compared together, about.
BLOCK, TASK_BLOCKS, HITS, COMPARED = 8192, 16, 1 << 20, 1 << 20


def align_all(asked: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """What align() finds for each pair that shares an integer of a window that isn't silent: rows of
    (position in asked, position in others, offset, overlap, bit errors). The integers of others are
    sorted once for all of asked."""
    la, lb = (np.array([len(f) for f in x], np.int64) for x in (asked, others))
    if not la.sum() or not lb.sum():
        return np.zeros((0, 5), np.int64)
    a, b = np.concatenate(asked), np.concatenate(others)
    begin_a, begin_b = np.r_[0, la.cumsum()], np.r_[0, lb.cumsum()]
    whose_a, whose_b = np.repeat(np.arange(len(la)), la), np.repeat(np.arange(len(lb)), lb)
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    hi[a == SILENT] = lo[a == SILENT]
    hits = np.r_[0, (hi - lo).cumsum()][begin_a]
    span, out, k = la.max() + lb.max(), [], 0
    while k < len(la):
        m = max(k + 1, int(np.searchsorted(hits, hits[k] + HITS, "right")) - 1)
        part = slice(begin_a[k], begin_a[m])
        counts = hi[part] - lo[part]
        ia = np.repeat(np.arange(part.start, part.stop), counts)
        ib = order[np.repeat(lo[part], counts) + np.arange(counts.sum()) - np.repeat(counts.cumsum() - counts, counts)]
        offset = (ib - begin_b[whose_b[ib]]) - (ia - begin_a[whose_a[ia]])
        found, equal = np.unique((whose_a[ia] * len(lb) + whose_b[ib]) * span + offset + la.max(), return_counts=True)
        k = m
        if not len(found):
            continue
        pair, offset = found // span, found % span - la.max()
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(pair)]))
        most = equal == np.maximum.reduceat(equal, first)[group]
        pair, offset = pair[most], offset[most]
        x, y = pair // len(lb), pair % len(lb)
        i0, overlap = np.maximum(0, -offset), np.minimum(la[x], lb[y] - offset) - np.maximum(0, -offset)
        errors, silent = _differing(a, b, begin_a[x] + i0, begin_b[y] + i0 + offset, overlap)
        overlap -= silent
        order_ = np.lexsort((offset, errors / overlap, pair))
        best = order_[np.r_[True, pair[order_][1:] != pair[order_][:-1]]]
        out.append(np.stack([c[best] for c in (x, y, offset, overlap, errors)], 1))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


def _differing(a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits, and windows silent on both sides, of each passage of n > 0 integers of a and b."""
    out, mute, ends, k = [], [], np.r_[0, n.cumsum()], 0
    while k < len(n):
        m = max(k + 1, int(np.searchsorted(ends, ends[k] + COMPARED, "right")) - 1)
        begin = ends[k:m] - ends[k]
        step = np.arange(ends[m] - ends[k])
        x, y = a[np.repeat(at_a[k:m] - begin, n[k:m]) + step], b[np.repeat(at_b[k:m] - begin, n[k:m]) + step]
        out.append(np.add.reduceat(np.bitwise_count(x ^ y), begin, dtype=np.int64))
        mute.append(np.add.reduceat((x == SILENT) & (y == SILENT), begin, dtype=np.int64))
        k = m
    return tuple(np.concatenate(c) if c else np.zeros(0, np.int64) for c in (out, mute))


def fingerprints(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """rec_id and fingerprint (array<int>) of each row."""
    prepare(media.sparkSession)
    at = cuts()

    def apply(batches):
        for b in batches:
            prints = [fingerprint(decode_wav(m), at).view(np.int32) for m in b.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rec_id"), pa.array(prints, pa.list_(pa.int32()))], ["rec_id", "fingerprint"])

    return media.select(F.col(id_col).cast("long").alias("rec_id"), F.col(media_col).alias("media")).mapInArrow(apply, "rec_id long, fingerprint array<int>")


def search(prints: DataFrame, queries: str) -> tuple[DataFrame, DataFrame]:
    """(classes, matches). prints: fingerprints()'s result. queries: an SQL condition on rec_id.

    classes: rec_id, class_id for each row, the smallest id with an equal fingerprint. matches:
    class_id, match_id, offset, overlap, bit_errors for each class with a query among its members and
    each other class that it matches."""
    rows = materialize(prints.withColumn("digest", F.when((F.size("fingerprint") > 0) & F.col("rec_id").isNotNull(), F.sha2(F.col("fingerprint").cast("string").cast("binary"), 256))), "chroma-prints")
    classes = materialize(attach_group_min(rows.select("rec_id", "digest"), ["digest"], "rec_id", "class_id").select("rec_id", F.coalesce("class_id", "rec_id").alias("class_id"), F.col("digest").isNotNull().alias("heard")), "chroma-classes")
    asked = classes.where("heard").where(queries).select("class_id").distinct()
    heads = materialize(rows.where("digest IS NOT NULL").join(classes.where("rec_id = class_id").select("rec_id").distinct(), "rec_id", "left_semi").groupBy("rec_id").agg(F.min("fingerprint").alias("fingerprint")), "chroma-heads")

    mine = _blocks(heads.join(asked.withColumnRenamed("class_id", "rec_id"), "rec_id", "left_semi"), "chroma-asked")
    every = _blocks(heads, "chroma-blocks")
    tasks = max(4 * prints.sparkSession.sparkContext.defaultParallelism, -(-every.count() // TASK_BLOCKS))
    met = every.repartition(tasks).hint("shuffle_replicate_nl").crossJoin(mine.toDF("asked_ids", "asked_sizes", "asked_values"))

    def verify(batches):
        for b in batches:
            out = [np.zeros((0, 5), np.int64)]
            for k in range(b.num_rows):
                (ia, fa), (ib, fb) = (_unpacked(b, k, p) for p in ("asked_", ""))
                found = align_all(fa, fb)
                a, m, (offset, overlap, errors) = ia[found[:, 0]], ib[found[:, 1]], found[:, 2:].T
                shorter = np.minimum(np.array([sounding(f) for f in fa])[found[:, 0]], np.array([sounding(f) for f in fb])[found[:, 1]])
                good = (a != m) & (overlap >= LEAST_OVERLAP * shorter) & (errors <= MOST_ERROR * 32 * overlap)
                out.append(np.stack([c[good] for c in (a, m, offset, overlap, errors)], 1))
            rows = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], ["class_id", "match_id", "offset", "overlap", "bit_errors"])

    schema = "class_id long, match_id long, offset long, overlap long, bit_errors long"
    return classes.select("rec_id", "class_id"), met.mapInArrow(verify, schema)


def _blocks(heads: DataFrame, name: str) -> DataFrame:
    """ids, sizes and values (fingerprints end to end) of recordings with BLOCK integers together, or of one longer."""

    def apply(batches):
        for b in batches:
            ids, values = b.column("rec_id").to_numpy(zero_copy_only=False), b.column("fingerprint")
            sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ends = values.flatten(), np.r_[0, sizes.cumsum()]
            cuts, k = [], 0
            while k < len(sizes):
                m = max(k + 1, int(np.searchsorted(ends, ends[k] + BLOCK, "right")) - 1)
                cuts.append((k, m))
                k = m
            columns = [[x[k:m] for k, m in cuts] for x in (ids, sizes)] + [[flat[ends[k]:ends[m]].to_numpy(zero_copy_only=False) for k, m in cuts]]
            kinds = (pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x.tolist() for x in c], pa.list_(k)) for c, k in zip(columns, kinds)], ["ids", "sizes", "values"])

    total = heads.agg(F.sum(F.size("fingerprint"))).first()[0] or 0
    dealt = heads.select("rec_id", "fingerprint").repartition(1 + total // (TASK_BLOCKS * BLOCK))
    return materialize(dealt.mapInArrow(apply, "ids array<long>, sizes array<int>, values array<int>"), name)


def _unpacked(b: pa.RecordBatch, k: int, prefix: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ids and fingerprints of a block."""
    ids, sizes, values = (b.column(f"{prefix}{c}")[k].values.to_numpy(zero_copy_only=False) for c in ("ids", "sizes", "values"))
    return ids, np.split(np.ascontiguousarray(values).view(np.uint32), sizes.cumsum()[:-1])


def listing(classes: DataFrame, matches: DataFrame) -> DataFrame:
    """The whole result: rec_id, class_id, match_id, offset, overlap, bit_errors. Each recording has a row
    with a null match_id; each match has a row under its queried class's smallest id, match_id being the
    smallest id of the class it matches."""
    members = classes.select("rec_id", "class_id", *(F.lit(None).cast("long").alias(c) for c in ("match_id", "offset", "overlap", "bit_errors")))
    return members.unionByName(matches.withColumn("rec_id", F.col("class_id")))


def summary(classes: DataFrame, matches: DataFrame) -> DataFrame:
    """A row for each recording: rec_id, class_id, n_matches (queried classes that match its class) and
    of the best of them (least share of differing bits, then smallest id) best_match, offset, overlap
    and bit_errors; nulls without a match."""
    rank = F.struct((-F.col("bit_errors") / F.col("overlap")).alias("closeness"), (-F.col("class_id")).alias("first"), "offset", "overlap", "bit_errors")
    best = matches.groupBy(F.col("match_id").alias("class_id")).agg(F.count(F.lit(1)).alias("n_matches"), F.max(rank).alias("best"))
    out = classes.join(best, "class_id", "left")
    return out.select("rec_id", "class_id", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), (-F.col("best.first")).alias("best_match"), "best.offset", "best.overlap", "best.bit_errors")


# --- recordings made from a table, as the tests' tables hold no audio ---------------------------------

NOTES, NOTE_SAMPLES = 16, 1000


@lru_cache(maxsize=4)
def _projection(n: int) -> np.ndarray:
    return np.random.default_rng(n).standard_normal((n, NOTES * 12))


def melody(vector, rate: int = RATE) -> np.ndarray:
    """A tune of NOTES tones whose pitch classes follow fixed random projections of a vector."""
    x = np.asarray([0.0 if v is None or not np.isfinite(v) else v for v in vector], float)
    if not len(x):
        return np.zeros(0)
    tones = (x @ _projection(len(x))).reshape(NOTES, 12).argmax(1)
    t = np.arange(NOTE_SAMPLES) / rate
    pitch = 220.0 * 2 ** (tones / 12)
    wave_ = sum(np.sin(2 * np.pi * h * pitch[:, None] * t) / h for h in (1, 2, 3))
    return 0.3 * (wave_ * np.hanning(NOTE_SAMPLES) ** 0.25).reshape(-1)


def recordings(vectors: DataFrame) -> DataFrame:
    """rec_id and media (WAV bytes) for each row of embeddings; a null vector has null media."""
    prepare(vectors.sparkSession)

    def apply(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):  # a recording is some 32 kB
                part = b.slice(lo, 64)
                media = [None if v is None else encode_wav(melody(v)) for v in part.column("embedding").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("rec_id"), pa.array(media, pa.binary())], ["rec_id", "media"])

    return vectors.select(F.col("vec_id").cast("long").alias("rec_id"), "embedding").mapInArrow(apply, "rec_id long, media binary")
