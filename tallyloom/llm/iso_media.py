"""ISO base media containers: writing a lossless one, and reading any one's facts.

``read_container`` walks the nested boxes of a file (32- and 64-bit sizes, boxes
that run to the end), decodes the sample tables of every track (stsd, stts,
stsc, stsz, stco or co64, stss) and gives codec, duration, sample and keyframe
byte ranges.  Payload bytes in ``mdat`` are never decoded; samples are located
by arithmetic on the tables alone.

``write_container`` stores a byte string as one track of 8-bit samples, in units
of ``unit`` bytes with a keyframe at the start of each chunk.

Defined results: a null payload is read as empty; it and the empty payload are
stored as one unit of zero bytes.  Equal payloads give equal files.  A malformed
file gives a row whose ``error`` says what was wrong and whose other facts are
null; a null file gives the error "null".  Repeated rows are independent.  Other
columns pass through, but those that have the name of a result are replaced.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyloom.llm.word_codes import slices

#: Boxes that hold boxes only.
CONTAINERS = frozenset([b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf", b"udta"])
#: Bytes in a sample, and samples in a chunk, of what ``write_container`` makes.
UNIT, CHUNK_SAMPLES = 64, 16
#: Samples (of 8 bits) a second: the time scale of what is written.
SAMPLE_RATE = 8000


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """The payload with zero bytes up to a positive multiple of ``unit``."""
    return payload + bytes(-len(payload) % unit if payload else unit)


_IDENTITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso2")


def write_container(payload: bytes, unit: int = UNIT, per_chunk: int = CHUNK_SAMPLES, rate: int = SAMPLE_RATE) -> bytes:
    """``padded(payload)`` as the one track of an ISO media file."""
    data = padded(payload, unit)
    samples = len(data) // unit
    chunks, last = -(-samples // per_chunk), (samples - 1) % per_chunk + 1
    first = len(_FTYP) + 8  # mdat comes before moov, so offsets don't depend on the tables
    runs = [(1, per_chunk)] if last == per_chunk or chunks == 1 else [(1, per_chunk), (chunks, last)]
    if chunks == 1:
        runs = [(1, last)]
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, rate << 16))
    table = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, samples, unit)),
        full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", at, n, 1) for at, n in runs)),
        full_box(b"stsz", struct.pack(">II", unit, samples)),
        full_box(b"stco", struct.pack(f">I{chunks}I", chunks, *range(first, first + len(data), unit * per_chunk))),
        full_box(b"stss", struct.pack(f">I{chunks}I", chunks, *range(1, samples + 1, per_chunk))),
    )
    handler = full_box(b"hdlr", bytes(4), b"soun", bytes(12), b"bytes\0")
    reference = box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1)))
    media = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, len(data), 0x55C4, 0)), handler, box(b"minf", full_box(b"smhd", bytes(4)), reference, table))
    track = box(b"trak", full_box(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, len(data), 0, 0, 0x100, 0), _IDENTITY, bytes(8), flags=3), media)
    header = full_box(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, rate, len(data), 0x10000, 0x100), _IDENTITY, bytes(24), struct.pack(">I", 2))
    return b"".join([_FTYP, box(b"mdat", data), box(b"moov", header, track)])


@dataclass
class Track:
    """What one track's boxes say."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    tables: dict = field(default_factory=dict)

    def samples(self) -> tuple[list[int], list[int]]:
        """Byte offset and size of every sample, from stsc, stsz and the chunk offsets."""
        fixed, sizes = self.tables.get("stsz", (0, ()))
        count = self.tables.get("count", 0)
        offsets = self.tables.get("chunks", ())
        runs = self.tables.get("stsc", ())
        at, out_sizes = [], []
        for r, (first, per, _) in enumerate(runs):
            after = runs[r + 1][0] if r + 1 < len(runs) else len(offsets) + 1
            for chunk in range(first - 1, after - 1):
                if chunk >= len(offsets):
                    raise ValueError("stsc names a chunk beyond the offsets")
                position = offsets[chunk]
                for _ in range(min(per, count - len(at))):
                    n = fixed or sizes[len(at)]
                    at.append(position)
                    out_sizes.append(n)
                    position += n
        if len(at) != count:
            raise ValueError("the sample tables disagree")
        return at, out_sizes


def walk(data: memoryview, start: int, end: int, level: int = 0):
    """(kind, body start, body end) of every box in order, parents before children."""
    if level > 16:
        raise ValueError("boxes nest too deeply")
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if body + 8 > end:
                raise ValueError("a box's size is cut off")
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        after = end if size == 0 else start + size
        if after < body or after > end:
            raise ValueError(f"box {kind.decode('latin-1')!r} runs past its parent")
        yield kind, body, after
        if kind in CONTAINERS:
            yield from walk(data, body, after, level + 1)
        start = after
    if start != end:
        raise ValueError("bytes remain after the last box")


def _table(data: memoryview, at: int, end: int, form: str) -> list[tuple]:
    """A version, flags and count, then rows of ``form``."""
    (n,) = struct.unpack_from(">I", data, at + 4)
    if at + 8 + n * struct.calcsize(form) > end:
        raise ValueError("a table is cut off")
    return list(struct.iter_unpack(form, data[at + 8 : at + 8 + n * struct.calcsize(form)]))


def read_container(data: bytes) -> tuple[str, list[Track], list[tuple[int, int]]]:
    """Brand, tracks, and the ranges of the media data."""
    view, brand, tracks, media = memoryview(data), "", [], []
    for kind, at, end in walk(view, 0, len(view)):
        if kind == b"ftyp":
            brand = bytes(view[at : at + 4]).decode("latin-1")
        elif kind == b"mdat":
            media.append((at, end))
        elif kind == b"trak":
            tracks.append(Track())
        elif tracks:
            track = tracks[-1]
            if kind == b"mdhd":
                track.timescale, track.duration = struct.unpack_from(">16xIQ" if view[at] else ">8xII", view, at + 4)
            elif kind == b"hdlr":
                track.handler = bytes(view[at + 8 : at + 12]).decode("latin-1")
            elif kind == b"stsd":
                track.codec = bytes(view[at + 12 : at + 16]).decode("latin-1").strip()
            elif kind == b"stts":
                track.tables["stts"] = _table(view, at, end, ">II")
            elif kind == b"stsc":
                track.tables["stsc"] = _table(view, at, end, ">III")
            elif kind == b"stsz":
                fixed, count = struct.unpack_from(">II", view, at + 4)
                track.tables["count"] = count
                track.tables["stsz"] = (fixed, () if fixed else struct.unpack_from(f">{count}I", view, at + 12))
            elif kind in (b"stco", b"co64"):
                track.tables["chunks"] = [x[0] for x in _table(view, at, end, ">I" if kind == b"stco" else ">Q")]
            elif kind == b"stss":
                track.tables["stss"] = [x[0] for x in _table(view, at, end, ">I")]
    return brand, tracks, media


TRACK = T.StructType(
    [
        T.StructField("handler", T.StringType()),
        T.StructField("codec", T.StringType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("samples", T.LongType()),
        T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def facts(data: bytes | None) -> tuple[dict, bytes | None]:
    """One row of ``probe`` and the bytes that the samples of all tracks cover, in order."""
    try:
        if data is None:
            raise ValueError("null")
        brand, tracks, _ = read_container(data)
        rows, pieces = [], []
        for t in tracks:
            at, sizes = t.samples()
            sync = t.tables.get("stss")
            if sync and (sync[0] < 1 or sync[-1] > len(at)):
                raise ValueError("a keyframe is beyond the samples")
            marks = range(len(at)) if sync is None else [s - 1 for s in sync]
            rows.append({"handler": t.handler, "codec": t.codec, "duration_s": t.duration / t.timescale if t.timescale else None, "samples": len(at), "keyframes": [{"start": at[i], "end": at[i] + sizes[i]} for i in marks]})
            for start, n in _runs(at, sizes):
                if start + n > len(data):
                    raise ValueError("a sample is beyond the file")
                pieces.append(data[start : start + n])
        return {"brand": brand, "tracks": rows, "error": None}, b"".join(pieces)
    except (ValueError, struct.error, IndexError) as e:
        return {"brand": None, "tracks": None, "error": str(e) or "malformed"}, None


def _runs(at: list[int], sizes: list[int]) -> list[tuple[int, int]]:
    """Neighbouring samples joined: (start, length)."""
    out: list[tuple[int, int]] = []
    for start, n in zip(at, sizes, strict=True):
        if out and out[-1][0] + out[-1][1] == start:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((start, n))
    return out


def store(df: DataFrame, payload_col: str = "payload", media_col: str = "media") -> DataFrame:
    """All columns of ``df`` but the payload, and the payload's container as ``media_col``."""
    kept = [c for c in df.columns if c.lower() not in (payload_col.lower(), media_col.lower())]
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(media_col, T.BinaryType(), False)])

    def run(batches):
        for batch in slices(batches, len(kept), 8 << 20):
            made = [write_container(p or b"") for p in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.binary())], names=schema.names)

    return df.select(*kept, payload_col).mapInArrow(run, schema)


def probe(df: DataFrame, media_col: str = "media", with_samples: bool = False) -> DataFrame:
    """All columns of ``df``, and brand, tracks and error of its containers.

    ``with_samples`` adds ``sample_bytes``: the stored bytes at the places that
    the sample tables give.
    """
    extra = [T.StructField("brand", T.StringType()), T.StructField("tracks", T.ArrayType(TRACK)), T.StructField("error", T.StringType())]
    if with_samples:
        extra.append(T.StructField("sample_bytes", T.BinaryType()))
    new = {f.name.lower() for f in extra}
    df = df.select(*(c for c in df.columns if c.lower() not in new))
    schema = T.StructType([*df.schema.fields, *extra])
    at = df.columns.index(media_col)
    tracks = pa.list_(
        pa.struct([("handler", pa.string()), ("codec", pa.string()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
    )

    def run(batches):
        for batch in slices(batches, at, 8 << 20):
            found = [facts(m) for m in batch.column(at).to_pylist()]
            columns = [pa.array([f["brand"] for f, _ in found], pa.string()), pa.array([f["tracks"] for f, _ in found], tracks), pa.array([f["error"] for f, _ in found], pa.string())]
            if with_samples:
                columns.append(pa.array([b for _, b in found], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)
