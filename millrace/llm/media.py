"""AVI motion-JPEG: write, index, decode, and cut into shots.

A payload of bytes is stored as the samples of 24 x 24 frames of 8-bit grey, each frame an intra-coded JPEG of the
lossless process (SOF3, predictor 1) in an AVI file with an index (idx1). The Huffman table of the writer gives a
difference of category c a code of 9 - c bits, and c more bits follow, so every sample takes 9 bits and whole clips are
coded and decoded as arrays; the reader also takes SOF3 frames of other sizes with other tables, bit by bit.

Shots: 16-bin histograms of successive frames are compared; a cut is where the difference exceeds the mean and DEVIATIONS
standard deviations of up to WINDOW differences before it, and LEAST of the frame's samples.

Edge cases: null or empty text is stored as empty, one frame of bytes 255; one frame is one clip; equal payloads give equal
files; of equal histogram differences each is judged by those before it; a long text is one file of as many frames, held in
memory as a whole; repeated rows and null ids each give a row; an empty table gives an empty result; other columns of the
input, whatever their names, are not looked at.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, release, ship, small

SIDE = 24
FRAME = SIDE * SIDE
FPS = 25
WINDOW = 8
DEVIATIONS = 2.0
LEAST = 0.1

_TABLE = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
_HEAD = b"\xff\xd8\xff\xc4" + struct.pack(">HB", 19 + 9, 0) + _TABLE + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0) + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
_END = b"\xff\xd9"


def _codes() -> np.ndarray:
    """The 9 bits of each difference from -255 to 255."""
    d = np.arange(-255, 256)
    c = np.array([int(abs(x)).bit_length() for x in d])
    extra = np.where(d < 0, d - 1, d) & ((1 << c) - 1)
    return ((((1 << (9 - c)) - 2) << c) | extra).astype(np.uint16)


_CODE = _codes()
_DIFF = np.zeros(512, np.int16)
_DIFF[_CODE] = np.arange(-255, 256)


def encode_frames(payload: bytes) -> list[bytes]:
    """The JPEG frames of a payload whose length is a multiple of FRAME."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    c = _CODE[d.reshape(-1, 8) + 255]
    b = np.empty((len(c), 9), np.uint8)
    b[:, 0], b[:, 8] = c[:, 0] >> 1, c[:, 7] & 255
    for j in range(1, 8):
        b[:, j] = (c[:, j - 1] & ((1 << j) - 1)) << (8 - j) | c[:, j] >> (j + 1)
    raw, step = b.tobytes(), FRAME * 9 // 8
    return [_HEAD + raw[i : i + step].replace(b"\xff", b"\xff\x00") + _END for i in range(0, len(raw), step)]


def write_avi(frames: list[bytes], width: int = SIDE, height: int = SIDE, fps: int = FPS) -> bytes:
    """An AVI file of one MJPG stream with its index."""
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    hdrl = b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", hdrl) + chunk(b"LIST", b"movi" + b"".join(movi)) + chunk(b"idx1", b"".join(index)))


def _stream_headers(data: bytes, at: int, end: int):
    """Where the streams' headers lie, in the order of the streams' numbers."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"strl":
            inner = at + 12
            while inner + 8 <= at + 8 + size:
                if data[inner : inner + 4] == b"strh":
                    yield inner + 8
                    break
                more = struct.unpack_from("<I", data, inner + 4)[0]
                inner += 8 + more + more % 2
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, the first video stream's frames in the order of the index); other streams are passed over."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, video, movi, index, at = 0.0, None, None, None, 12
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        kind = data[at + 8 : at + 12]
        if name == b"LIST" and kind == b"hdrl":
            for number, s in enumerate(_stream_headers(data, at + 12, at + 8 + size)):
                if video is None and data[s : s + 4] == b"vids":
                    scale, rate = struct.unpack_from("<II", data, s + 20)
                    fps, video = rate / scale, b"%02d" % number
        elif name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi is None or index is None or video is None:
        raise ValueError("no index, no frames or no video stream")
    frames = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name in (video + b"dc", video + b"db"):
            frames.append(data[movi + offset + 8 : movi + offset + 8 + size])
    return fps, frames


def _parse(frame: bytes) -> dict:
    """Markers of a lossless JPEG frame."""
    out, at = {"table": None}, 2
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xC4:
            out["table"] = body[1:]
        elif marker == 0xC3:
            out["bits"], out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            if n != 1 or out["bits"] != 8:
                raise ValueError("only 8-bit frames of one component are decoded")
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only the lossless process is decoded")
        at += 2 + size
        if marker == 0xDA:
            if body[3] != 1:
                raise ValueError("only predictor 1 is decoded")
            return out | {"scan": at}


def _slow_differences(scan: bytes, table: bytes, n: int) -> np.ndarray:
    """n differences, with any Huffman table."""
    codes, code, k = {}, 0, 16
    for bits in range(1, 17):
        for _ in range(table[bits - 1]):
            codes[bits, code] = table[k]
            code, k = code + 1, k + 1
        code <<= 1
    stream = "".join(f"{x:08b}" for x in scan)
    out, at = [], 0
    for _ in range(n):
        end = at + 1
        while (end - at, int(stream[at:end], 2)) not in codes:
            end += 1
        c = codes[end - at, int(stream[at:end], 2)]
        v = int(stream[end : end + c], 2) if c else 0
        out.append(v if not c or v >> (c - 1) else v - (1 << c) + 1)
        at = end + c
    return np.array(out, np.int16)


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """The samples, (frames, height, width)."""
    if all(f.startswith(_HEAD) for f in frames):
        raw = b"".join([f[len(_HEAD) : -2].replace(b"\xff\x00", b"\xff") for f in frames])
        b = np.frombuffer(raw, np.uint8).reshape(-1, 9).astype(np.uint16)
        c = np.empty((len(b), 8), np.uint16)
        for i in range(8):
            c[:, i] = (b[:, i] & ((1 << (8 - i)) - 1)) << (i + 1) | b[:, i + 1] >> (7 - i)
        d = _DIFF[c].reshape(len(frames), SIDE, SIDE)
    else:
        parts = []
        for f in frames:
            p = _parse(f)
            scan = f[p["scan"] : f.rindex(_END)].replace(b"\xff\x00", b"\xff")
            parts.append(_slow_differences(scan, p["table"], p["height"] * p["width"]).reshape(p["height"], p["width"]))
        d = np.stack(parts)
    d = d.astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return np.cumsum(d, axis=2).astype(np.uint8)


def shots(frames: np.ndarray) -> list[tuple[int, int]]:
    """[first, end) of each shot."""
    n, size = len(frames), frames[0].size
    flat = (frames.reshape(n, -1) >> 4).astype(np.int64) + 16 * np.arange(n)[:, None]
    hist = np.bincount(flat.ravel(), minlength=16 * n).reshape(n, 16)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * size)
    cuts = []
    for i, x in enumerate(diff):
        before = diff[max(0, i - WINDOW) : i]
        if x > LEAST and (not len(before) or x > before.mean() + DEVIATIONS * before.std()):
            cuts.append(i + 1)
    return list(zip([0, *cuts], [*cuts, n]))


def store(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, filled with 255 to whole frames, as an AVI file."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        for batch in small(batches):
            sizes, files = [], []
            for t in batch.column(1).to_pylist():
                raw = (t or "").encode()
                sizes.append(len(raw))
                files.append(write_avi(encode_frames(raw + b"\xff" * (FRAME - len(raw) % FRAME if len(raw) % FRAME or not raw else 0))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [doc_id, "n_bytes", "media"])
        release()

    return ship(docs).select(doc_id, text).mapInArrow(run, f"{doc_id} {kind}, n_bytes long, media binary")


CLIP = "array<struct<clip: int, first_frame: int, end_frame: int, start_s: double, end_s: double>>"


def read(media: DataFrame) -> DataFrame:
    """The columns of ``media``, payload (the samples read back) and clips."""
    names = media.columns

    def run(batches):
        at = names.index("media")
        clip = pa.struct([("clip", pa.int32()), ("first_frame", pa.int32()), ("end_frame", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64())])
        for batch in small(batches):
            payloads, clips = [], []
            for file in batch.column(at).to_pylist():
                fps, frames = read_avi(file)
                samples = decode_frames(frames)
                payloads.append(samples.tobytes())
                clips.append([{"clip": i, "first_frame": a, "end_frame": b, "start_s": a / fps, "end_s": b / fps} for i, (a, b) in enumerate(shots(samples))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(payloads, pa.binary()), pa.array(clips, pa.list_(clip))], [*names, "payload", "clips"])
        release()

    kinds = dict(media.dtypes)
    return ship(media).mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "payload binary", f"clips {CLIP}"]))


def clip_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each timed clip."""
    return read(store(docs, doc_id, text)).select(doc_id, F.explode("clips").alias("c")).select(doc_id, "c.*")


def op4_media(spark, sf_dir: str) -> DataFrame:
    got = read(store(documents(spark, sf_dir)))
    cuts = F.array_join(F.transform("clips", lambda c: F.concat_ws("-", c["first_frame"], c["end_frame"])), ",")
    size = F.octet_length("payload")
    return got.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("clips="), F.size("clips").cast("string"), F.lit(";frames="), cuts).alias("feature"),
    )
