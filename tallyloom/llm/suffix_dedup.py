"""Removal of repeated substrings, exact at any size, through sharded suffix arrays.

A byte goes if it lies in a ``width``-byte string that also starts earlier: in a
row with a smaller id, or earlier in the same one.  Strings are judged on the
input as it is, and matches never cross rows.

1. Anchors.  Every window of ``width`` bytes elects one of its ``GRAM``-byte
   grams: the one with the least hash, the leftmost of equals.  Equal windows
   elect equal grams at equal places, so all copies of a window meet under one
   gram.  Neighbouring windows mostly elect the same gram; the run of windows
   that share one is a segment.  Segments that repeat inside a task are settled
   there, so a segment that is everywhere leaves each task once.
2. Segments are dealt by gram.  One equal (by two 64-bit digests) to an earlier
   segment holds only repeated windows.  Grams that have segments of different
   content pass the first of each on.
3. Suffix arrays.  Those segments' bytes are fetched and dealt by gram; a shard
   concatenates them in row order and builds its suffix array by induced sorting
   and its permuted common prefixes.  A run of suffixes that share ``width``
   bytes is one window's occurrences; all but the least repeat it.
4. A gram with more than ``shard_segments`` different segments is split into
   shards of that size; digests of each one's first windows then meet in a
   grouped minimum, so nothing is lost and no task holds the whole group.
5. Each row's covered ranges are merged and cut.

Defined results: a null text is read as empty; texts shorter than the width keep
all bytes; null ids come before all others; ids that aren't whole numbers go by
their place in sorted order; rows with the same id count as the
same document (equal places in them don't repeat each other); other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.word_codes import give_back, slices
from tallyloom.llm.common import released, text_of, written
from tallyloom.llm.suffix_array import _codes, permuted_prefixes, suffix_array

#: Bytes of a gram that a window can elect.
GRAM = 32
#: Text bytes that one suffix array holds, about.
SHARD_BYTES = 1 << 19
#: Segments of a task that are compared with each other at a time.
TASK_SEGMENTS = 500_000
_LOWEST = -(1 << 63)
_PLACE_BITS = 24


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of the ``GRAM`` bytes from each place on (zeros follow the data)."""
    codes = _codes(data)
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    for at in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h[:-at] += codes[at:]
        h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    return h


def segments(data: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, first window, windows, gram hash) of each run of windows that elect one gram.

    ``data`` holds texts side by side, text t from bounds[t] to bounds[t + 1]; it
    has fewer than 2**24 bytes.
    """
    windows = np.maximum(np.diff(bounds) - width + 1, 0)
    if not windows.any():
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(data)
    # The upper bits of the hash, then the place: the least is the leftmost of equals.
    ranked = (hashes & ~np.uint64((1 << _PLACE_BITS) - 1)) | np.arange(len(data), dtype=np.uint64)
    span, reach = width - GRAM + 1, 1
    while 2 * reach <= span:
        ranked = np.minimum(ranked[:-reach], ranked[reach:])
        reach *= 2
    elected = np.minimum(ranked[: len(data) - width + 1], ranked[span - reach : span - reach + len(data) - width + 1])
    text = np.repeat(np.arange(len(windows)), windows)
    first = np.cumsum(windows) - windows
    place = np.arange(len(text)) - np.repeat(first - bounds[:-1], windows)
    elected = elected[place]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (elected[1:] != elected[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.concatenate((at, [len(text)])))
    gram = hashes[(elected[at] & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)]
    return text[at], place[at], runs, gram


def merged(start: np.ndarray, end: np.ndarray, groups: list[np.ndarray]) -> list[np.ndarray]:
    """Overlapping or touching ranges of a group joined; the last of ``groups`` sorts least."""
    order = np.lexsort((start, *groups[::-1]))
    start, end, groups = start[order], end[order], [g[order] for g in groups]
    if not len(start):
        return [start, end, *groups]
    new = np.ones(len(start), dtype=bool)
    same = np.ones(len(start) - 1, dtype=bool)
    for g in groups:
        same &= g[1:] == g[:-1]
    # Ends rise within a group when ranges have one length; a running maximum covers the rest.
    block = np.concatenate(([0], np.cumsum(~same)))
    shift = block * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift) - shift
    new[1:] = ~same | (start[1:] > reach[:-1])
    at = np.flatnonzero(new)
    last = np.concatenate((at[1:], [len(start)])) - 1
    return [start[at], reach[last], *(g[at] for g in groups)]


_OUT = T.StructType(
    [
        T.StructField("gram", T.LongType()),  # null: a range that is settled
        T.StructField("segment", T.LongType()),
        T.StructField("doc", T.LongType()),
        T.StructField("row", T.LongType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("n", T.IntegerType()),  # windows of a segment, bytes of a range
    ]
)


def _signed(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a).view(np.int64)


def _range_batch(start, end, doc, row) -> pa.RecordBatch:
    n = len(start)
    return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array(doc), pa.array(row), pa.array(start.astype(np.int32)), pa.array((end - start).astype(np.int32))], schema=pa.schema([("gram", pa.int64()), ("segment", pa.int64()), ("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))


def anchors(docs: DataFrame, width: int) -> DataFrame:
    """Segments of all texts (columns doc, row, text), those that repeat in a task already settled."""

    def settle(parts: list[tuple]):
        gram, segment, doc, row, start, n = (np.concatenate([p[i] for p in parts]) for i in range(6))
        order = np.lexsort((start, doc, segment, gram))
        gram, segment, doc, row, start, n = (x[order] for x in (gram, segment, doc, row, start, n))
        new = np.ones(len(gram), dtype=bool)
        new[1:] = (gram[1:] != gram[:-1]) | (segment[1:] != segment[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(gram)), 0))
        again = ~((doc == doc[first]) & (start == start[first]))
        keep = ~again
        yield pa.RecordBatch.from_arrays([pa.array(gram[keep]), pa.array(segment[keep]), pa.array(doc[keep]), pa.array(row[keep]), pa.array(start[keep].astype(np.int32)), pa.array(n[keep].astype(np.int32))], names=_OUT.names)
        if again.any():
            begin = start[again]
            s, e, d, r = merged(begin, begin + n[again] + width - 1, [doc[again], row[again]])
            yield _range_batch(s, e, d, r)

    def run(batches):
        held, count = [], 0
        for batch in slices(batches, 2, 1 << 22):
            column = batch.column(2)
            lengths = np.asarray(pa.compute.binary_length(column)).astype(np.int64)
            docs_, rows = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            raw = b"".join(column.to_pylist())
            # A batch above 2**24 bytes (one very long text among others) goes text by text, a text above it in overlapping parts.
            for texts, base, shift in _parts(lengths, width):
                lo = int(lengths[: texts[0]].sum()) + base if len(texts) else 0
                size = int(lengths[texts].sum()) if shift is None else shift
                data = np.frombuffer(raw, np.uint8, size, lo)
                bounds = np.concatenate(([0], np.cumsum(lengths[texts]))) if shift is None else np.array([0, size])
                t, place, n, gram = segments(data, bounds, width)
                if not len(t):
                    continue
                view, digest = memoryview(data), xxhash.xxh3_64_intdigest
                segment = np.fromiter((digest(view[a:b]) for a, b in zip(place.tolist(), (place + n + width - 1).tolist(), strict=True)), dtype=np.uint64, count=len(t))
                held.append((_signed(gram), _signed(segment), docs_[texts][t], rows[texts][t], place - bounds[t] + base, n))
                count += len(t)
            if count > TASK_SEGMENTS:
                yield from settle(held)
                held, count = [], 0
        if held:
            yield from settle(held)

    return docs.mapInArrow(run, _OUT)


def _parts(lengths: np.ndarray, width: int):
    """(text numbers, offset in the text, bytes or None for whole texts) of at most 2**24 - 1 bytes each."""
    most = (1 << _PLACE_BITS) - 1
    if int(lengths.sum()) <= most:
        yield np.arange(len(lengths)), 0, None
        return
    for t, n in enumerate(lengths.tolist()):
        if n <= most:
            yield np.array([t]), 0, None
        else:
            # Parts share width - 1 bytes, so each window is in exactly one.
            for base in range(0, n - width + 1, most - width + 1):
                yield np.array([t]), base, min(most, n - base)


_MET = T.StructType([*_OUT.fields, T.StructField("shard", T.IntegerType())])


def meet(dealt: DataFrame, width: int, shard_segments: int) -> DataFrame:
    """Ranges of segments that repeat an earlier one, and segments whose gram has others.

    Reads segments sorted by (gram, segment, doc, start) and holds one row between batches.
    """

    def run(batches):
        tail = None  # the last segment's first row, whether it has been passed on, and its number in the gram
        for batch in batches:
            if not batch.num_rows:
                continue
            gram, segment, doc, row, start, n = (np.asarray(c).astype(np.int64) for c in batch.columns)
            passed, number = False, 0
            if tail is not None:
                (*values, passed, number) = tail
                gram, segment, doc, row, start, n = (np.concatenate(([v], x)) for v, x in zip(values, (gram, segment, doc, row, start, n), strict=True))
            size = len(gram)
            new_gram, new_segment = np.ones(size, dtype=bool), np.ones(size, dtype=bool)
            new_gram[1:] = gram[1:] != gram[:-1]
            new_segment[1:] = new_gram[1:] | (segment[1:] != segment[:-1])
            at = np.flatnonzero(new_segment)
            first = at[np.cumsum(new_segment) - 1]
            again = ~((doc == doc[first]) & (start == start[first]))
            if again.any():
                begin = start[again]
                s, e, d, r = merged(begin, begin + n[again] + width - 1, [doc[again], row[again]])
                found = _range_batch(s, e, d, r)
                yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(len(s), pa.int32())], names=_MET.names)
            opens = new_gram[at].copy()
            opens[0] = tail is None or number == 0  # the held row's gram may have had segments before it
            block = np.cumsum(opens) - 1 if opens[0] else np.cumsum(opens)
            heads = np.flatnonzero(opens) if opens[0] else np.concatenate(([0], np.flatnonzero(opens)))
            index = np.arange(len(at)) - heads[block] + np.where(block == 0, number, 0)
            follows = np.zeros(len(at), dtype=bool)
            follows[:-1] = ~new_gram[at[1:]]
            several = (index > 0) | follows
            if passed:
                several[0] = False
            # A segment's first row is not its only one where a row has the same place: such rows hold the same text.
            out = at[several]
            if len(out):
                yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (gram, segment, doc, row)] + [pa.array(x[out].astype(np.int32)) for x in (start, n)] + [pa.array((index[several] // shard_segments).astype(np.int32))], names=_MET.names)
            last = at[-1]
            tail = (gram[last], segment[last], doc[last], row[last], start[last], n[last], bool(passed if len(at) == 1 and tail is not None and not several[-1] else several[-1]), int(index[-1]))
        give_back()

    return dealt.mapInArrow(run, _MET)


_SHARD_ROWS = T.StructType([T.StructField("gram", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("doc", T.LongType()), T.StructField("row", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("bytes", T.BinaryType())])


def fetch(wanted: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The bytes of the segments that ``meet`` passed on."""
    lists = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("gram", "shard", "start", "n")).alias("segments"))

    def run(batches):
        for batch in slices(batches, 2):
            out = []
            for doc, row, data, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(s["gram"], s["shard"], doc, row, s["start"], data[s["start"] : s["start"] + s["n"] + width - 1]) for s in found]
            for i in range(0, len(out), 20_000):
                part = list(zip(*out[i : i + 20_000], strict=True))
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(part, types, strict=True)], names=_SHARD_ROWS.names)

    # Rows with one id and one text are one document: one copy of the bytes is enough.
    once = docs.join(lists, ["doc", "row"]).select("doc", "row", "text", "segments")
    return once.mapInArrow(run, _SHARD_ROWS)


def repeated_windows(parts: list[bytes], place: list[tuple[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of byte strings given in row order: (string, offset, repeats an earlier place).

    ``place`` has each string's document and start.
    """
    lengths = np.array([len(p) for p in parts])
    # UTF-8 has no bytes above 0xF7, so two more symbols fit: 1 parts the strings, 0 ends the text.
    raw = np.frombuffer(b"\xff".join(parts) + b"\xfe", np.uint8)
    text = raw + np.uint8(2)
    order = suffix_array(text)
    common = permuted_prefixes(text, order, width)
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    windows = np.maximum(lengths - width + 1, 0)
    number = np.repeat(np.arange(len(parts)), windows)
    offset = np.arange(len(number)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = bounds[number] + offset
    is_window = np.zeros(len(text), dtype=bool)
    is_window[at] = True
    order = order[is_window[order]]
    run = np.cumsum(common[order] < width)
    leads = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
    least = np.minimum.reduceat(order, leads) if len(order) else order
    first = np.empty(len(text), dtype=np.int64)
    first[order] = np.repeat(least, np.diff(np.concatenate((leads, [len(order)]))))
    owner = np.zeros(len(text), dtype=np.int64)
    owner[at] = number
    doc, start = (np.array([p[i] for p in place], dtype=np.int64) for i in (0, 1))
    f = first[at]
    whose = owner[f]
    same_place = (doc[whose] == doc[number]) & (start[whose] + f - bounds[whose] == start[number] + offset)
    return number, offset, ~same_place


_FOUND = T.StructType([T.StructField("doc", T.LongType()), T.StructField("row", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("window", T.BinaryType())])


def arrays(fetched: DataFrame, width: int, shard_segments: int) -> DataFrame:
    """Repeated ranges that suffix arrays find in the fetched segments.

    Also digests (``window``) of the first windows of shards whose gram may have other shards.
    """
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("window", pa.binary())])

    def settle(rows: list[tuple]):
        # Row order is (doc, start): a smaller place in the text is then an earlier one.
        rows.sort(key=lambda r: (r[2], r[4]))
        number, offset, again = repeated_windows([r[5] for r in rows], [(r[2], r[4]) for r in rows], width)
        doc, row, start = (np.array([r[i] for r in rows], dtype=np.int64) for i in (2, 3, 4))
        if again.any():
            begin = start[number[again]] + offset[again]
            s, e, d, r = merged(begin, begin + width, [doc[number[again]], row[number[again]]])
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(r), pa.array(s.astype(np.int32)), pa.array((e - s).astype(np.int32)), pa.nulls(len(s), pa.binary())], schema=schema)
        sizes: dict[tuple[int, int], int] = {}
        for r in rows:
            sizes[r[:2]] = sizes.get(r[:2], 0) + 1
        split = np.array([r[1] > 0 or sizes[r[:2]] >= shard_segments for r in rows])
        if split.any():
            kept = np.flatnonzero(split[number] & ~again)
            for i in range(0, len(kept), 50_000):
                k = kept[i : i + 50_000]
                digests = [xxhash.xxh3_128_digest(rows[a][5][b : b + width]) for a, b in zip(number[k].tolist(), offset[k].tolist(), strict=True)]
                a = number[k]
                yield pa.RecordBatch.from_arrays([pa.array(doc[a]), pa.array(row[a]), pa.array((start[a] + offset[k]).astype(np.int32)), pa.array(np.full(len(k), width, dtype=np.int32)), pa.array(digests, pa.binary())], schema=schema)

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SHARD_BYTES and r[:2] != last:
                    yield from settle(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[5])
                last = r[:2]
        if held:
            yield from settle(held)
        give_back()

    return fetched.repartition("gram", "shard").sortWithinPartitions("gram", "shard").mapInArrow(run, _FOUND)


def repeated_ranges(docs: DataFrame, width: int, shard_segments: int) -> DataFrame:
    """(doc, row, start, n): byte ranges that repeat earlier ones; they may overlap."""
    found = written(anchors(docs, width), "anchors")
    dealt = found.where("gram is not null").repartition("gram").sortWithinPartitions("gram", "segment", "doc", "start")
    met = written(meet(dealt, width, shard_segments), "met")
    shards = written(arrays(fetch(met.where("gram is not null"), docs, width), width, shard_segments), "arrays")
    # Shards of one split gram: a window's first places, one for each shard, meet here.
    firsts = shards.where("window is not null")
    least = firsts.groupBy("window").agg(F.min(F.struct("doc", "start")).alias("least"), F.count("*").alias("shards")).where("shards > 1").select("window", "least")
    across = firsts.join(least, "window").where((F.col("doc") != F.col("least.doc")) | (F.col("start") != F.col("least.start")))
    columns = ["doc", "row", "start", "n"]
    parts = [found.where("gram is null"), met.where("gram is null"), shards.where("window is null"), across]
    ranges = parts[0].select(columns)
    for p in parts[1:]:
        ranges = ranges.unionByName(p.select(columns))
    out = written(ranges, "ranges")
    released(found, met, shards)
    return out


def cut(data: bytes, ranges: list[tuple[int, int]], whole_characters: bool = False) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the (start, length) ranges, and the maximal removed (start, end).

    ``whole_characters`` leaves in place a UTF-8 character that is covered in part only.
    """
    spans: list[list[int]] = []
    for start, n in sorted(ranges):
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], start + n)
        else:
            spans.append([start, start + n])
    if whole_characters:
        for span in spans:
            a, b = span
            while a < b and data[a] & 0xC0 == 0x80:
                a += 1
            while a < b < len(data) and data[b] & 0xC0 == 0x80:
                b -= 1
            span[:] = a, b
        spans = [x for x in spans if x[0] < x[1]]
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    kept.append(data[at:])
    return b"".join(kept), [(a, b) for a, b in spans]


def dedup(df: DataFrame, width: int = 100, shard_segments: int = 4096, id_col: str = "doc_id", text_col: str = "text", whole_characters: bool = False) -> DataFrame:
    """(id, n_bytes, kept binary, spans, carried): one row for each input row.

    ``kept`` are the remaining bytes, ``spans`` the maximal removed ranges, and
    ``carried`` is a struct of the input's other columns (null if it has none).
    """
    others = [F.col(c) for c in df.columns if c not in (id_col, text_col)]
    carried = F.struct(*others) if others else F.lit(None).cast("int")
    whole = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), carried.alias("carried"))
    if isinstance(df.schema[id_col].dataType, T.IntegralType):
        whole = whole.withColumn("doc", F.coalesce(F.col("id").cast("long"), F.lit(_LOWEST)))
    else:
        # Other ids go by their number in order: sorted over all partitions, and numbered as they are written.
        ids = written(whole.select("id").distinct().orderBy(F.col("id").asc_nulls_first()).select("id", F.monotonically_increasing_id().alias("doc")), "ids")
        whole = whole.join(ids, whole["id"].eqNullSafe(ids["id"])).select(whole["id"], "text", "carried", "doc")
    whole = whole.select("doc", F.xxhash64("text").alias("row"), F.encode("text", "UTF-8").alias("text"), "id", "carried")
    docs = whole.select("doc", "row", "text")
    ranges = repeated_ranges(docs, width, shard_segments)
    lists = ranges.groupBy("doc", "row").agg(F.collect_set(F.struct("start", "n")).alias("ranges"))
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("kept", T.BinaryType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
            T.StructField("carried", whole.schema["carried"].dataType),
        ]
    )
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in slices(batches, 1, 8 << 20):
            done = [cut(data, [(r["start"], r["n"]) for r in found or ()], whole_characters) for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            sizes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in done]
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([k for k, _ in done], pa.binary()), pa.array(spans, spans_type), batch.column(3)], names=schema.names)

    return whole.join(lists, ["doc", "row"], "left").select("id", "text", "ranges", "carried").mapInArrow(run, schema)
