"""Media columns: AVI files of motion JPEG, held as binary columns.

A payload of bytes is stored as 8-bit grey samples, 64 to a line and up to 64 lines to a frame.
Frames are lossless JPEG (ITU-T T.81, process 14: SOF3, predictor 1 with a restart at each line,
one Huffman table of nine 4-bit codes), every frame is an intra frame, and the RIFF file has the
usual hdrl, movi and idx1 parts.  Reading goes through the index: each frame is found, parsed and
decoded to its samples, and shots are cut where the difference between neighbouring frames'
histograms exceeds a threshold that adapts to the differences around it.

All symbols of a batch of lines are coded and decoded in step, so no Python loop runs over samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64
LINES = 64
FRAMES_PER_SECOND = 25
#: Lines coded at once.
LINE_BATCH = 2048
_CATEGORY = np.array([int(v).bit_length() for v in range(256)], np.int64)
# Huffman table: nine codes of 4 bits for the categories 0..8.
_DHT = b"\xff\xc4" + struct.pack(">H", 2 + 1 + 16 + 9) + b"\x00" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9))
_SOS = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 1, 0, 0)
_DRI = b"\xff\xdd" + struct.pack(">HH", 4, WIDTH)


def encode_lines(samples: np.ndarray) -> list[bytes]:
    """Entropy-coded bytes of each line of samples (n x 64), filled with ones to a byte and stuffed."""
    out: list[bytes] = []
    for lo in range(0, len(samples), LINE_BATCH):
        x = samples[lo : lo + LINE_BATCH].astype(np.int64)
        diff = np.diff(x, axis=1, prepend=128)
        size = _CATEGORY[np.abs(diff)]
        extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
        code, length = (size << size) | extra, size + 4
        fill = -length.sum(axis=1) % 8
        code = np.concatenate([code, ((1 << fill) - 1)[:, None]], axis=1)
        length = np.concatenate([length, fill[:, None]], axis=1)
        down = np.arange(11, -1, -1, dtype=np.uint16)
        bits = ((code.astype(np.uint16)[:, :, None] >> down) & 1).astype(np.uint8)
        real = down < length.astype(np.uint16)[:, :, None]
        packed = np.packbits(bits[real])
        ends = np.cumsum(length.sum(axis=1)) // 8
        stuffed = np.insert(packed, np.flatnonzero(packed == 0xFF) + 1, 0)
        before = np.concatenate([[0], np.cumsum(packed == 0xFF)])
        stops = ends + before[ends]
        raw, at = stuffed.tobytes(), 0
        for stop in stops.tolist():
            out.append(raw[at:stop])
            at = stop
    return out


def decode_lines(lines: list[bytes]) -> np.ndarray:
    """The samples (n x 64) of entropy-coded lines whose stuffing has been removed."""
    out = np.empty((len(lines), WIDTH), np.uint8)
    for lo in range(0, len(lines), LINE_BATCH):
        part = lines[lo : lo + LINE_BATCH]
        sizes = np.array([len(x) for x in part])
        wide = int(sizes.max()) + 4
        grid = np.frombuffer(b"".join(x.ljust(wide, b"\xff") for x in part), np.uint8).astype(np.uint32)
        # 24 bits from each byte on
        three = (grid << 16) | (np.append(grid[1:], 0).astype(np.uint32) << 8) | np.append(grid[2:], [0, 0]).astype(np.uint32)
        base, bit = np.arange(len(part)) * wide, np.zeros(len(part), np.int64)
        last = np.full(len(part), 128, np.int64)
        for k in range(WIDTH):
            word = (three[base + (bit >> 3)] << (8 + (bit & 7)).astype(np.uint32)) >> np.uint32(16)
            size = (word >> 12).astype(np.int64)
            value = ((word.astype(np.int64) & 0xFFF) >> (12 - size))
            last = (last + np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)) & 0xFF
            out[lo : lo + len(part), k] = last
            bit += 4 + size
    return out


def frame_sizes(payload_bytes: int) -> list[int]:
    """Lines of each frame."""
    lines = payload_bytes // WIDTH
    return [LINES] * (lines // LINES) + ([lines % LINES] if lines % LINES else [])


def jpeg(lines: list[bytes]) -> bytes:
    head = b"\xff\xd8" + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, len(lines), WIDTH, 1, 1, 0x11, 0) + _DHT + _DRI + _SOS
    parts = [head]
    for i, line in enumerate(lines):
        if i:
            parts.append(bytes((0xFF, 0xD0 + (i - 1) % 8)))
        parts.append(line)
    return b"".join(parts) + b"\xff\xd9"


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def avi(frames: list[bytes]) -> bytes:
    """A RIFF AVI file with one motion-JPEG stream and an idx1 index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // FRAMES_PER_SECOND, largest * FRAMES_PER_SECOND, 0, 0x10, len(frames), 0, 1, largest, WIDTH, LINES, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FRAMES_PER_SECOND, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, LINES)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, LINES, 1, 8, b"MJPG", WIDTH * LINES, 0, 0, 0, 0)
    strl = _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + strl)
    body, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    riff = b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", riff)


def write_media(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload (a positive multiple of 64 bytes)."""
    lines = iter(encode_lines(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH)))
    return [avi([jpeg([next(lines) for _ in range(n)]) for n in frame_sizes(len(p))]) for p in payloads]


def read_index(data: bytes) -> list[tuple[int, int]]:
    """(place, size) of each frame, from the RIFF lists and the idx1 index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, found = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            found = [(x[2], x[3]) for x in struct.iter_unpack("<4sIII", data[at + 8 : at + 8 + size]) if x[0] == b"00dc"]
        at += 8 + size + size % 2
    if movi is None or found is None:
        raise ValueError("no movi list or no index")
    return [(movi + place + 8, size) for place, size in found]


def coded_lines(frame: bytes) -> list[bytes]:
    """The coded lines of one frame, their stuffing removed."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, height = 2, 0
    while frame[at + 1] != 0xDA:
        size = struct.unpack_from(">H", frame, at + 2)[0]
        if frame[at + 1] == 0xC3:
            height, width = struct.unpack_from(">HH", frame, at + 5)
            if width != WIDTH:
                raise ValueError("unexpected width")
        at += 2 + size
    at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    data = frame[at:-2]
    for i in range(8):  # a restart marker cannot occur inside stuffed data
        data = data.replace(b"\xff" + bytes((0xD0 + i,)), b"\xff\xd0")
    lines = [x.replace(b"\xff\x00", b"\xff") for x in data.split(b"\xff\xd0")]
    if len(lines) != height:
        raise ValueError("lines are missing")
    return lines


def read_media(files: list[bytes]) -> list[list[np.ndarray]]:
    """The frames (lines x 64 samples) of each file."""
    lines, shape = [], []
    for data in files:
        sizes = []
        for place, size in read_index(data):
            own = coded_lines(data[place : place + size])
            lines += own
            sizes.append(len(own))
        shape.append(sizes)
    samples, at, out = decode_lines(lines), 0, []
    for sizes in shape:
        out.append([])
        for n in sizes:
            out[-1].append(samples[at : at + n])
            at += n
    return out


def shots(frames: list[np.ndarray], window: int = 4, factor: float = 1.5, floor: float = 0.08) -> list[tuple[int, int]]:
    """(first frame, end frame) of each shot.

    A cut stands before a frame whose 16-bin histogram differs from the one before by more than `floor`
    and by more than `factor` times the mean difference of the `window` neighbours on either side.
    """
    if not frames:
        return []
    hist = np.stack([np.bincount(f.ravel() >> 4, minlength=16) / max(f.size, 1) for f in frames])
    diff = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = [0]
    for i, d in enumerate(diff.tolist()):
        around = np.concatenate([diff[max(0, i - window) : i], diff[i + 1 : i + 1 + window]])
        if d > max(floor, factor * (around.mean() if len(around) else 0.0)):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(frames)]))


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"


def text_media(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as an AVI file.

    The payload is the text's UTF-8 and zero bytes up to a positive multiple of 64; null counts as
    empty; equal texts give equal files; rows with equal doc_id each get a row; an empty table none.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in _parts(batch, 1 << 20):
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                files = write_media([t + bytes(-len(t) % WIDTH or (0 if t else WIDTH)) for t in texts])
                yield pa.record_batch([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(write, MEDIA_SCHEMA)


def _parts(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of about `limit` bytes in the second column."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + limit, "right")))
        yield lo, batch.slice(lo, hi - lo)
        lo = hi


CLIP_SCHEMA = "doc_id long, n_bytes long, payload binary, media binary, clips array<struct<first_frame: int, end_frame: int, start_s: double, end_s: double, mean_level: double>>"


def media_clips(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload (the samples read back), media, clips (timed shots) of a media column."""
    clip = pa.struct([("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean_level", pa.float64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _parts(batch.select(["doc_id", "media", "n_bytes"]), 1 << 20):
                files = part.column(1).to_pylist()
                payloads, clips = [], []
                for frames in read_media(files):
                    payloads.append(b"".join(f.tobytes() for f in frames))
                    clips.append([
                        {"first_frame": a, "end_frame": b, "start_s": a / FRAMES_PER_SECOND, "end_s": b / FRAMES_PER_SECOND, "mean_level": round(float(np.concatenate([f.ravel() for f in frames[a:b]]).mean()), 3)}
                        for a, b in shots(frames)
                    ])
                yield pa.record_batch([part.column(0), part.column(2), pa.array(payloads, pa.binary()), part.column(1), pa.array(clips, pa.list_(clip))], names=["doc_id", "n_bytes", "payload", "media", "clips"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, CLIP_SCHEMA)


def clip_rows(clips: DataFrame) -> DataFrame:
    """doc_id, clip (from 0), first_frame, end_frame, start_s, end_s, mean_level: a row for each timed clip of media_clips."""
    return clips.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: digests of the stored files and of what is read back from them, and the shots as a feature string."""
    read = media_clips(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    listed = lambda xs: F.array_join(xs, ",")
    feature = F.concat(
        F.lit("frames="), F.element_at("clips", -1)["end_frame"], F.lit(";shots="), F.size("clips"),
        F.lit(";cuts="), listed(F.transform(F.slice("clips", 2, F.size("clips")), lambda c: c["first_frame"].cast("string"))),
        F.lit(";levels="), listed(F.transform("clips", lambda c: F.format_string("%.3f", c["mean_level"]))),
    )
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )
