"""Fill-in-the-middle transformation, its cuts found on a wavelet matrix.

The bytes of a batch of texts fall into four classes: line ends, other ASCII
white space, continuation bytes of UTF-8, and all else.  A wavelet matrix holds
the classes as two bit vectors, the second in the stable order that the first
gives.  Rank on it counts a class in any range of bytes: line ends and a last
open line give a text's units, bytes less continuation bytes its code points.  A
cut after k lines is the k-th line end by select; a cut after k code points is
found by bisection on the combined rank.  All texts of a batch are asked at
once, and a batch is bounded by bytes, so a very long text costs its own size.

The draws come from a SHA-256 digest of seed and id, so a row's result depends
on nothing but its own id and text, wherever and however often it is computed.

Defined results: a null text is read as empty; an empty text is ``plain``, with
no units; so is one that holds a marker, since its parts could not be told again;
a null id draws like the empty string.  Repeated rows and ties each give their
own row; an empty table gives none.  Columns of the input that have the name of a
result are replaced in any case, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import named_again, numbered
from tallyloom.llm.word_codes import BATCH_BYTES, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

OTHER, LINE_END, SPACE, CONTINUES = range(4)

#: Class of each byte.
CLASSES = np.array([LINE_END if b == 10 else SPACE if b in b" \t\x0b\f\r" else CONTINUES if 128 <= b < 192 else OTHER for b in range(256)], dtype=np.uint8)

#: Units that a text may be cut into.
UNITS = ("line", "char")


class Bits:
    """A bit vector with the number of ones before each byte of it."""

    def __init__(self, bits: np.ndarray):
        self.packed = np.append(np.packbits(bits, bitorder="little"), np.uint8(0))
        self.before = np.zeros(len(self.packed) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.packed), out=self.before[1:])
        self.zeros = len(bits) - int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        at, low = i >> 3, (1 << (i & 7)) - 1
        return self.before[at] + np.bitwise_count(self.packed[at] & low.astype(np.uint8))


class WaveletMatrix:
    """Ranks and places of four classes over a sequence of bytes."""

    def __init__(self, data: np.ndarray):
        classes = CLASSES[data]
        high = classes >> 1
        self.size = len(data)
        self.first = Bits(high)
        self.second = Bits(np.concatenate([classes[high == 0], classes[high == 1]]) & 1)

    def rank(self, kind: int, i: np.ndarray) -> np.ndarray:
        """How many bytes before place ``i`` are of the class."""
        i = np.asarray(i, dtype=np.int64)
        start = np.zeros_like(i)
        for bits, one in ((self.first, kind >> 1), (self.second, kind & 1)):
            ends = []
            for at in (start, i):
                ones = bits.rank1(at)
                ends.append(bits.zeros + ones if one else at - ones)
            start, i = ends
        return i - start

    def chars(self, i: np.ndarray) -> np.ndarray:
        """How many code points begin before place ``i``."""
        return i - self.rank(CONTINUES, i)

    def end_of_line(self, k: np.ndarray) -> np.ndarray:
        """The place after the ``k``-th line end, counted from 1 over the whole sequence."""
        return self._least(k, lambda i: self.rank(LINE_END, i))

    def start_of_char(self, k: np.ndarray) -> np.ndarray:
        """The least place before which ``k`` code points begin."""
        return self._least(k, self.chars)

    def _least(self, k: np.ndarray, count) -> np.ndarray:
        """By bisection, the least place with at least ``k`` counted before it."""
        k = np.asarray(k, dtype=np.int64)
        low, high = np.zeros_like(k), np.full_like(k, self.size)
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            enough = count(mid) >= k
            high = np.where(open_ & enough, mid, high)
            low = np.where(open_ & ~enough, mid + 1, low)
        return low


def units_and_cuts(data: np.ndarray, starts: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str) -> tuple[np.ndarray, ...]:
    """For texts laid end to end: units, byte places of both cuts, code points of prefix and of middle.

    Text t is ``data[starts[t]:starts[t + 1]]``; ``h1`` and ``h2`` draw the cuts.
    """
    matrix = WaveletMatrix(data)
    begin, end = starts[:-1], starts[1:]
    if unit == "line":
        lines = matrix.rank(LINE_END, starts)
        ended = np.zeros(len(begin), dtype=bool)
        some = end > begin
        ended[some] = data[end[some] - 1] == 10
        n = np.diff(lines) + (some & ~ended)
    else:
        n = np.diff(matrix.chars(starts))
    drawn = np.stack([h1 % (n + 1), h2 % (n + 1)])
    places = []
    for k in (drawn.min(0), drawn.max(0)):
        if unit == "line":
            # The last unit may lack its line end: its end is the text's.
            place = np.where(k == n, end, matrix.end_of_line(lines[:-1] + np.minimum(k, np.diff(lines))))
        else:
            place = np.where(k == n, end, matrix.start_of_char(matrix.chars(begin) + k + 1) - 1)
        places.append(np.where(k == 0, begin, place))
    first, second = places
    at = matrix.chars(np.concatenate([begin, first, second])).reshape(3, -1)
    return n, first, second, at[1] - at[0], at[2] - at[1]


def _draws(id_col: str, seed: str) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(
    df: DataFrame,
    seed: str = "7",
    rate: int = 100,
    spm_rate: int = 50,
    unit: str = "line",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """All columns of ``df`` and n, form, prefix_chars, middle_chars, output.

    ``rate`` of a hundred texts are transformed, of those ``spm_rate`` of a hundred with the suffix first (``spm``), the others
    with the prefix first (``psm``); all others are ``plain``, with the text as output and null counts of characters.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    names = df.columns
    at = {n: f"in_{i}" for i, n in enumerate(names)}
    held = numbered(df)
    draws = [h.alias(f"h{i}") for i, h in enumerate(_draws(at[id_col], seed), 1)]
    held = held.select("*", F.coalesce(F.col(at[text_col]), F.lit("")).alias("whole"), *draws)
    added = [
        T.StructField("n", T.LongType(), False),
        T.StructField("form", T.StringType(), False),
        T.StructField("prefix_chars", T.LongType()),
        T.StructField("middle_chars", T.LongType()),
        T.StructField("output", T.StringType(), False),
    ]
    kept = [f for f in held.schema.fields if f.name.startswith("in_")]
    schema = T.StructType([*kept, *added])
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, width, BATCH_BYTES):
            texts = pa.concat_arrays([batch.column(width)]).cast(pa.large_binary())
            h1, h2, h3, h4 = (np.asarray(batch.column(width + i)) for i in range(1, 5))
            starts = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
            source = texts.buffers()[2]
            data = np.frombuffer(source, dtype=np.uint8)[starts[0] : starts[-1]] if source else np.empty(0, np.uint8)
            starts = starts - starts[0]
            n, first, second, prefix, middle = units_and_cuts(data, starts, h1, h2, unit)
            plain = (starts[1:] == starts[:-1]) | (h3 % 100 >= rate)
            for marker in (PREFIX, SUFFIX, MIDDLE):
                plain |= np.asarray(pc.match_substring(batch.column(width), marker))
            spm = h4 % 100 < spm_rate
            view = memoryview(data)
            output = []
            for a, b, c, d, whole, turned in zip(starts[:-1].tolist(), first.tolist(), second.tolist(), starts[1:].tolist(), plain.tolist(), spm.tolist()):
                if whole:
                    output.append(bytes(view[a:d]))
                elif turned:
                    output.append(b"".join((b"<S>", view[c:d], b"<P>", view[a:b], b"<M>", view[b:c])))
                else:
                    output.append(b"".join((b"<P>", view[a:b], b"<S>", view[c:d], b"<M>", view[b:c])))
            form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
            made = [
                pa.array(n, pa.int64()),
                pa.array(form.tolist(), pa.string()),
                pa.array(prefix, pa.int64(), mask=plain),
                pa.array(middle, pa.int64(), mask=plain),
                pa.array(output, pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *made], names=schema.names)

    return held.mapInArrow(run, schema).select(*named_again(names, *(f.name for f in added)))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: a text with a marker is plain, so the markers that stand first are the transformation's."""

    def between(start: Column, end: Column) -> Column:
        return F.substring(output, start + 3, end - start - 3)

    first = F.lit(1)
    second = F.when(form == "psm", F.locate(SUFFIX, output, 4)).otherwise(F.locate(PREFIX, output, 4))
    third = F.locate(MIDDLE, output, 4)
    outer, inner, middle = between(first, second), between(second, third), F.substring(output, third + 3, F.length(output))
    return F.when(form == "psm", F.concat(outer, middle, inner)).when(form == "spm", F.concat(inner, middle, outer)).otherwise(output)
