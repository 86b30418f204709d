"""Media columns from ISO base media containers.

A container is a tree of boxes (32-bit size, four-letter type; size 1: a 64-bit size follows, size 0: to the end). The
reader walks nested boxes, decodes the sample tables of each track (times, chunks, sizes, sync samples) and gives codec,
duration and the byte ranges of key frames; payloads are not decoded. The writer stores bytes as one track of 8-bit
samples, FRAME of them to an access unit, and opens every chunk with a key frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

#: 8-bit samples of an access unit, access units of a chunk, samples a second of the tracks that are written.
FRAME, CHUNK_FRAMES, RATE = 64, 64, 8000

#: Box types that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body if len(body) < 2**32 - 8 else struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(text: str | None) -> tuple[int, bytes]:
    """The text's UTF-8 length, and its bytes with zeros up to a positive multiple of FRAME."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % FRAME if raw else FRAME)


def write(payload: bytes) -> bytes:
    """A container whose one track holds the payload, whose length is a positive multiple of FRAME."""
    frames = len(payload) // FRAME
    chunks = -(-frames // CHUNK_FRAMES)
    runs = [(1, CHUNK_FRAMES)] if chunks > 1 or frames == CHUNK_FRAMES else []
    if frames % CHUNK_FRAMES:
        runs.append((chunks, frames % CHUNK_FRAMES))
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    wide = len(payload) >= 2**31

    def moov(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.int64) * (FRAME * CHUNK_FRAMES)
        sync = 1 + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, frames, FRAME)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, n, 1) for c, n in runs)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            full(b"stss", struct.pack(">I", chunks), sync.astype(">u4").tobytes()),
            full(b"co64" if wide else b"stco", struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes()),
        )
        duration = struct.pack(">IIII", 0, 0, RATE, min(len(payload), 2**32 - 1))
        matrix = struct.pack(">9i", 65536, 0, 0, 0, 65536, 0, 0, 0, 1 << 30)
        dref = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        mdia = box(b"mdia", full(b"mdhd", duration, struct.pack(">HH", 0x55C4, 0)), full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"), box(b"minf", full(b"smhd", bytes(4)), dref, stbl))
        tkhd = full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, min(len(payload), 2**32 - 1)), bytes(8), struct.pack(">hhhH", 0, 0, 256, 0), matrix, bytes(8), flags=7)
        return box(b"moov", full(b"mvhd", duration, struct.pack(">IHH", 65536, 256, 0), bytes(8), matrix, bytes(24), struct.pack(">I", 2)), box(b"trak", tkhd, mdia))

    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    data = box(b"mdat", payload)
    first = len(head) + len(moov(0)) + len(data) - len(payload)
    return head + moov(first) + data


def walk(data, start: int = 0, end: int | None = None):
    """(path, body start, body end) of every box, depth first; a box that runs beyond its parent ends with it. Open boxes are held in a list, so depth is not bounded by the interpreter's stack."""
    todo = [(start, len(data) if end is None else end, ())]
    while todo:
        start, end, path = todo.pop()
        while start + 8 <= end:
            size, kind = struct.unpack_from(">I4s", data, start)
            body = start + 8
            if size == 1 and body + 8 <= end:
                (size,) = struct.unpack_from(">Q", data, body)
                body += 8
            stop = end if size == 0 else min(end, start + size)
            if stop < body:
                break
            yield (*path[-6:], kind), body, stop  # tables lie seven boxes deep at most
            start = stop
            if kind in CONTAINERS:
                todo.append((stop, end, path))
                start, end, path = body, stop, (*path[-6:], kind)


def table(data, at: int, end: int, fields: int, form: str = ">u4") -> np.ndarray:
    """Entries of a counted table of so many numbers each, as an array with a row for each entry."""
    (n,) = struct.unpack_from(">I", data[at:end], 4)
    width = np.dtype(form).itemsize * fields
    n = min(n, max(0, (end - at - 8) // width))
    return np.frombuffer(data, form, n * fields, at + 8).astype(np.int64).reshape(n, fields)


def read_box(t: dict, kind: bytes, data: bytes, at: int, end: int) -> None:
    """Adds what a box of a track says. No table has more entries than its box has room for, and no more samples than the file has bytes."""
    if kind == b"mdhd":
        wide = data[at:end][:1] == b"\1"
        t["timescale"], t["duration"] = struct.unpack_from(">IQ" if wide else ">II", data[at:end], 20 if wide else 12)
    elif kind == b"hdlr":
        t["handler"] = data[at + 8 : min(end, at + 12)].decode("latin-1")
    elif kind == b"stsd":
        t["codec"] = data[at + 12 : min(end, at + 16)].decode("latin-1")
    elif kind == b"stts":
        t["times"] = table(data, at, end, 2)
    elif kind == b"stsc":
        t["runs"] = table(data, at, end, 3)
    elif kind == b"stsz":
        same, n = struct.unpack_from(">II", data[at:end], 4)
        t["sizes"] = np.full(min(n, len(data) // same), same, np.int64) if same else table(data, at + 4, end, 1)[:, 0]
    elif kind == b"stss":
        t["sync"] = table(data, at, end, 1)[:, 0]
    elif kind in (b"stco", b"co64"):
        t["chunks"] = table(data, at, end, 1, ">u4" if kind == b"stco" else ">u8")[:, 0]


def read(data: bytes | None) -> list[dict]:
    """The tracks of a container: codec, handler, timescale, duration, and arrays of samples' offsets, sizes, times and sync flags.

    Null, empty or cut containers, and bytes of another kind, give the tracks whose boxes can be read (none, if there is none).
    """
    data = data or b""
    tracks: list[dict] = []
    for path, at, end in walk(data):
        if path[-1] == b"trak":
            tracks.append({"codec": "", "handler": "", "timescale": 0, "duration": 0})
        elif b"trak" in path and tracks:
            try:
                read_box(tracks[-1], path[-1], data, at, end)
            except struct.error:  # a box without its fields
                tracks[-1]["broken"] = True
    return [samples(t) for t in tracks if "broken" not in t and {"times", "runs", "sizes", "chunks"} <= t.keys()]


def repeated(values: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The first `most` of values repeated so many times; counts of foreign files may be of any size."""
    upto = np.minimum(most, np.cumsum(np.clip(counts, 0, most), dtype=np.float64)).astype(np.int64)
    return np.repeat(values, np.diff(upto, prepend=0))


def samples(t: dict) -> dict:
    """Expands a track's run-length tables to one entry for each sample."""
    chunks, runs, sizes = t["chunks"], t["runs"], t["sizes"]
    n = len(sizes)
    upto = np.append(runs[1:, 0], len(chunks) + 1)
    each = repeated(runs[:, 1], upto - runs[:, 0], len(chunks))
    owner = repeated(np.arange(len(each)), each, n)
    before = np.cumsum(sizes) - sizes
    opens = np.searchsorted(owner, owner)  # the chunk's first sample
    offsets = chunks[owner] + before[: len(owner)] - before[opens]
    delta = repeated(t["times"][:, 1], t["times"][:, 0], n)
    sync = np.zeros(n, bool)
    if "sync" in t:
        sync[t["sync"][(t["sync"] >= 1) & (t["sync"] <= n)] - 1] = True
    else:
        sync[:] = True  # no table: every sample is a key frame
    return {k: t[k] for k in ("codec", "handler", "timescale", "duration")} | {"offsets": offsets, "sizes": sizes[: len(offsets)], "starts": np.cumsum(delta) - delta, "sync": sync[: len(offsets)]}


def payload(data: bytes, track: dict) -> bytes:
    """The track's stored bytes in sample order; samples that follow each other in the file are read at once."""
    offsets, sizes = track["offsets"], track["sizes"]
    if not len(offsets):
        return b""
    breaks = np.flatnonzero(offsets[1:] != offsets[:-1] + sizes[:-1]) + 1
    first, last = np.append(0, breaks), np.append(breaks, len(offsets)) - 1
    return b"".join(data[a:b] for a, b in zip(offsets[first].tolist(), (offsets[last] + sizes[last]).tolist(), strict=True))


def keyframes(track: dict) -> list[tuple[int, int]]:
    return list(zip(track["offsets"][track["sync"]].tolist(), track["sizes"][track["sync"]].tolist(), strict=True))


def media_columns(df: DataFrame, id_col: str = "media_id", media_col: str = "media") -> DataFrame:
    """One row for each track of every container: id, track int, codec, handler, timescale, duration, n_samples, keyframes array<struct<offset,size>>.

    A null, empty or foreign value has no tracks and so no row; repeated rows give repeated rows; other columns are not read.
    """

    def make():
        return lambda part: [(i, k, t["codec"], t["handler"], t["timescale"], t["duration"], len(t["sizes"]), [{"offset": a, "size": b} for a, b in keyframes(t)]) for i, data in part for k, t in enumerate(read(data))]

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, media_col), make, f"`{id_col}` {kind}, track int, codec string, handler string, timescale long, duration long, n_samples long, keyframes array<struct<offset:long,size:long>>")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text as a container: id, n_bytes long (unpadded UTF-8), media binary. A null text is empty."""

    def make():
        return lambda part: [(i, n, write(p)) for i, t in part for n, p in [padded(t)]]

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, text_col), make, f"`{id_col}` {kind}, n_bytes long, media binary")


def features(data: bytes) -> tuple[str, bytes]:
    """A line of what media_columns() finds in a container's first track, and the payload read back."""
    track = read(data)[0]
    keys = keyframes(track)
    marks = hashlib.sha256(np.array(keys, ">u8").tobytes()).hexdigest()[:16]
    return f"codec={track['codec'].strip()} rate={track['timescale']} duration={track['duration']} samples={len(track['sizes'])} keyframes={len(keys)} first={keys[0][0]}+{keys[0][1]} last={keys[-1][0]}+{keys[-1][1]} ranges={marks}", payload(data, track)


def digests(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What is read back from containers made by store_texts(): id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def make():
        def rows(part):
            out = []
            for i, n, data in part:
                feature, p = features(data)
                out.append((i, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-FRAME:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            return out

        return rows

    kind = df.schema[id_col].dataType.simpleString()
    return map_rows(df.select(id_col, "n_bytes", media_col), make, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
