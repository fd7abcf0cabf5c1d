"""ISO media containers as columns: pack texts as 8-bit grey video, walk boxes, read sample tables.

The reader walks nested boxes and decodes the sample tables of the first video or audio track; it
stores codec, duration and the byte ranges of key frames and never decodes a payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A frame is 16 by 12 samples of 8 bits, 25 frames a second, 40 frames a chunk, every 12th a key frame.
WIDTH, HEIGHT, FRAME = 16, 12, 192
RATE, PER_CHUNK, KEY_EVERY = 25, 40, 12
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
#: Boxes nested deeper than this are not walked: no format nests a tenth as deep, and a damaged one may as deep as it is long.
DEEPEST = 64
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 bytes of a text (null: empty) with spaces up to a positive multiple of 192, and the bytes before that."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)), len(raw)


def packed(payload: bytes) -> bytes:
    """A container that holds the payload as raw 8-bit grey frames; equal payloads give equal bytes."""
    n = len(payload) // FRAME
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    chunks = -(-n // PER_CHUNK)
    runs = [(1, PER_CHUNK, 1)] if n >= PER_CHUNK else []
    if n % PER_CHUNK:
        runs.append((chunks, n % PER_CHUNK, 1))
    starts = len(kind) + head + np.arange(chunks, dtype=np.int64) * PER_CHUNK * FRAME
    wide = bool(chunks) and int(starts[-1]) >= 1 << 32
    offsets = _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), starts.astype(">u8" if wide else ">u4").tobytes())
    keys = np.arange(1, n + 1, KEY_EVERY)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIII", WIDTH, HEIGHT, 0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1))
    tables = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        offsets,
        _full(b"stss", struct.pack(">I", len(keys)), keys.astype(">u4").tobytes()),
    )
    where = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
    track = _box(
        b"trak",
        _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(16), MATRIX, struct.pack(">II", WIDTH << 16, HEIGHT << 16), flags=7),
        _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"text\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), where, tables),
        ),
    )
    movie = _box(b"moov", _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, n), struct.pack(">IH", 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)), track)
    return kind + _box(b"mdat", payload) + movie


def boxes(data: bytes) -> Iterator[tuple[tuple, int, int]]:
    """(path, start, end) of every box's body, containers before what they hold; a damaged box ends the walk of its level."""
    levels: list[tuple[tuple, int, int]] = [((), 0, len(data))]  # depth costs no recursion
    while levels:
        path, at, end = levels.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > end:
                continue
            (size,) = struct.unpack_from(">Q", data, at + 8)
            body = at + 16
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            continue
        levels.append((path, stop, end))
        if len(path) < DEEPEST:
            yield (*path, kind), body, stop
            if kind in CONTAINERS:
                levels.append(((*path, kind), body, stop))


def _table(data: bytes, at: int, columns: int, kind: str = ">u4") -> np.ndarray:
    (n,) = struct.unpack_from(">I", data, at + 4)
    return np.frombuffer(data, kind, n * columns, at + 8).reshape(n, columns).astype(np.int64)


def described(data: bytes) -> dict | None:
    """Codec, timing, and each sample's offset, size and key flag of the first track with samples; None without one."""
    found: dict[bytes, tuple[int, int]] = {}
    tracks: list[dict[bytes, tuple[int, int]]] = []
    for path, start, end in boxes(data):
        if path[-1] == b"trak":
            tracks.append(found := {})
        elif b"trak" in path:
            found.setdefault(path[-1], (start, end))
    for track in tracks:
        if not {b"mdhd", b"stsd", b"stts", b"stsc"} <= track.keys() or not {b"stco", b"co64"} & track.keys() or b"stsz" not in track:
            continue
        at = track[b"mdhd"][0]
        scale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
        entry = track[b"stsd"][0] + 8
        codec = data[entry + 4 : entry + 8].decode("latin-1")
        one, n = struct.unpack_from(">II", data, track[b"stsz"][0] + 4)
        if one * n > len(data):
            raise ValueError("more samples than the file has bytes for")
        sizes = np.full(n, one, np.int64) if one else np.frombuffer(data, ">u4", n, track[b"stsz"][0] + 12).astype(np.int64)
        chunks = _table(data, track[b"co64"][0], 1, ">u8")[:, 0] if b"co64" in track else _table(data, track[b"stco"][0], 1)[:, 0]
        runs = _table(data, track[b"stsc"][0], 3)
        lengths = np.diff(np.r_[runs[:, 0] - 1, len(chunks)])
        per_chunk = np.repeat(runs[:, 1], lengths)
        upto = np.cumsum(per_chunk)
        chunk = np.searchsorted(upto, np.arange(n), side="right")  # a chunk's claimed number of samples takes no memory
        before = np.r_[0, np.cumsum(sizes)[:-1]] if n else sizes
        first = upto - per_chunk
        offsets = chunks[chunk] + before - before[first[chunk]] if n else sizes
        if n and (offsets + sizes).max() > len(data):
            raise ValueError("a sample lies beyond the file")
        keys = _table(data, track[b"stss"][0], 1)[:, 0] - 1 if b"stss" in track else np.arange(n)
        times = _table(data, track[b"stts"][0], 2)
        return {"codec": codec, "timescale": scale, "duration": duration, "decoded_time": int((times[:, 0] * times[:, 1]).sum()), "offsets": offsets, "sizes": sizes, "keys": keys}
    return None


def stored_payload(data: bytes, info: dict) -> bytes:
    """The samples' bytes in order, neighbouring samples read at once."""
    offsets, sizes = info["offsets"], info["sizes"]
    if not len(offsets):
        return b""
    cut = np.flatnonzero(np.r_[True, offsets[1:] != offsets[:-1] + sizes[:-1]])
    ends = np.r_[cut[1:] - 1, len(offsets) - 1]
    return b"".join(data[offsets[a] : offsets[a] + int(offsets[b] + sizes[b] - offsets[a])] for a, b in zip(cut, ends, strict=True))


def media_columns(media: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Per input row: id, codec, duration_s, n_samples and keyframes as an array of (offset, length).

    The content column holds container bytes. Samples are those of the sample tables, so a fragmented
    file has what its movie box lists. Null, empty or damaged bytes and containers without
    samples give a null codec and duration, 0 samples and no ranges. Repeated rows are read each by
    itself; other columns are ignored.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []  # one row of small columns each
            for key, data in zip(batch["id"], batch["content"], strict=True):
                try:
                    info = described(bytes(data)) if data is not None else None
                except (struct.error, ValueError, IndexError):
                    info = None
                if info is None:
                    out.append((key, None, None, 0, []))
                    continue
                ranges = [{"start": int(info["offsets"][k]), "length": int(info["sizes"][k])} for k in info["keys"] if 0 <= k < len(info["sizes"])]
                out.append((key, info["codec"], info["duration"] / info["timescale"] if info["timescale"] else None, len(info["sizes"]), ranges))
            yield pd.DataFrame(out, columns=["id", "codec", "duration_s", "n_samples", "keyframes"]).astype({"id": "Int64"})

    picked = media.select(F.col(id_col).cast("long").alias("id"), F.col(content_col).cast("binary").alias("content"))
    return picked.mapInPandas(kernel, "id long, codec string, duration_s double, n_samples long, keyframes array<struct<start: long, length: long>>")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id and content, the container that holds the text's padded bytes (null text: empty)."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                part = batch.iloc[i : i + 1000]
                yield pd.DataFrame({"id": part["id"].astype("Int64").values, "content": [packed(padded(t)[0]) for t in part["text"]]})

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(kernel, "id long, content binary")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row the digests of the text's container and of the payload that is read back from it.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature. A null text counts as empty (192 spaces); equal texts give equal values; the container is
    built, parsed and dropped row by row, so memory is bounded by the longest text.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                payload, n = padded(text)
                data = packed(payload)
                info = described(data)
                back = stored_payload(data, info)
                keys = info["keys"]
                ranges = ",".join(f"{int(info['offsets'][k])}+{int(info['sizes'][k])}" for k in keys)
                feature = f"{info['codec'].strip()} {WIDTH}x{HEIGHT} duration={info['duration']}/{info['timescale']} samples={len(info['sizes'])} keyframes={len(keys)} ranges={hashlib.md5(ranges.encode()).hexdigest()}"
                out.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({"doc_id": "Int64"})

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInPandas(kernel, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
