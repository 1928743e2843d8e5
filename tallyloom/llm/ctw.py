"""Language-model scores of texts by context-tree weighting.

A text is its tokens (words of the lower-cased text, then an end) written as the
words joined by spaces and a line feed.  Training texts' bytes fill one context
tree; every text's score is the log10 probability that the tree's mixture gives
its bytes, and the code length per byte follows from it.

Blocks and parts.  A task cuts its rows into blocks of bounded text and keeps, of
each block, the packed texts, the distinct grams with their training counts (in
ascending chunks) and the distinct words with theirs.  Parts are ranges of grams,
as many as keep the grams that all blocks have in one near ``GRAMS_PER_PART``; a
hot context is simply cut through.  A part's subtrees are whole but for the few
contexts at its two ends.  Sums of these edges are passed up level by level as
small tables and come back to the parts that they belong to.  A part then answers
each block's grams, and a block scores its texts with its answers (32-bit floats
on the way).  What is shuffled grows with the distinct grams of the blocks, and
nothing but the cuts, eight bytes a part, passes the driver.

Words are counted the same way (dealt by hash) for the unigram base score
log10((c + 1) / (N + V + 1)), summed over tokens.

Defined results: a null text is read as empty, and its only token is the end; a
null id trains if ``training`` says so; ids may be of any type that is told by its
text; repeated rows each count and are each scored; other columns are ignored; with no training
rows every prediction is 1/2 a bit and the base score is that of N = V = 0; an
empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import LOWER, written
from tallyloom.llm.ctw_model import contexts_cut, edge_sums, edges_of, grams_of, log_probabilities, snapped, weighed
from tallyloom.llm.word_codes import slices

END = b"\n"
#: Text bytes of a block, and of one packed run of texts in it.
BLOCK_BYTES, PACK_BYTES = 24 << 20, 1 << 20
#: Grams of a chunk; grams of all blocks' chunks in a part, on average; bytes of text for each part of the words.
CHUNK_GRAMS, GRAMS_PER_PART, WORD_PART_BYTES = 1 << 15, 1_500_000, 32 << 20
_GRAMS, _WORDS, _TEXTS = 0, 1, 2

#: ``lo``: a chunk's least gram.
_PIECE = T.StructType([*(T.StructField(n, t) for n, t in (("block", T.LongType()), ("kind", T.IntegerType()), ("part", T.IntegerType()), ("lo", T.LongType()), ("keys", T.BinaryType()), ("values", T.BinaryType())))])
_DEALT = T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(n, t) for n, t in (("block", T.LongType()), ("keys", T.BinaryType()), ("values", T.BinaryType())))])
_EDGE = "part int, depth int, node long, zeros double, ones double, below double"


def _packed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _packed_ids(ids: tuple) -> bytes:
    """Row ids, numbers or texts (null: nothing), as their UTF-8 lengths and then their bytes."""
    said = [b"" if i is None else str(i).encode() for i in ids]
    return np.array([len(x) for x in said], dtype="<u4").tobytes() + b"".join(said)


def _unpacked_ids(raw: bytes, n: int, at: int) -> tuple[list[str], int]:
    """``n`` ids as texts, and where what follows them begins."""
    ends = at + 4 * n + np.cumsum(np.frombuffer(raw, "<u4", n, at).astype(np.int64))
    starts = [at + 4 * n, *ends[:-1].tolist()]
    return [raw[a:b].decode() for a, b in zip(starts, ends.tolist())], int(ends[-1]) if n else at


def _pack_numbers(a: np.ndarray) -> bytes:
    """Ascending numbers as packed differences."""
    return _packed(np.diff(a, prepend=a.dtype.type(0)).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()) if len(a) else b""


def _unpack_numbers(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(_unpacked(data), dtype=np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.uint64).ravel(), dtype=np.uint64)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.empty(0, dtype=np.int64)
    return every[starts], np.add.reduceat(n, starts) if len(starts) else n


class _Block:
    """The texts of one block, reduced as they come."""

    def __init__(self, number: int, depth: int, word_parts: int, chunk: int):
        self.number, self.depth, self.word_parts, self.chunk = number, depth, word_parts, chunk
        self.size, self.held = 0, 0
        self.texts: list[bytes] = []
        self.heads: list[tuple] = []
        self.packs: list[bytes] = []
        self.words: Counter = Counter()
        self.seen: set = set()
        self.raw: list[tuple[bytes, bool]] = []
        self.grams, self.counts = [], []

    def add(self, row_id, text: str | None, trains: bool) -> None:
        words = (text or "").encode().translate(LOWER).split()
        line = b" ".join(words) + END
        self.raw.append((line, trains))
        if trains:
            self.words.update(words)
            self.words[END] += 1
        else:
            self.seen.update(words)
            self.seen.add(END)
        self.heads.append((row_id, row_id is None, trains, len(line)))
        self.held += len(line)
        self.size += len(line)
        if self.held >= PACK_BYTES:
            self.pack()

    def pack(self) -> None:
        """Texts since the last call: packed for scoring, their grams counted."""
        if not self.raw:
            return
        ids, *others = zip(*self.heads, strict=True)
        nulls, trains, sizes = map(np.array, others)
        head = struct.pack("<I", len(ids)) + _packed_ids(ids) + nulls.astype("u1").tobytes() + trains.astype("u1").tobytes() + sizes.astype("<u4").tobytes()
        self.packs.append(_packed(head + b"".join(line for line, _ in self.raw)))
        for wanted in (True, False):
            lines = [line for line, t in self.raw if t == wanted]
            if lines:
                grams = np.concatenate([grams_of(line, self.depth, END[0]) for line in lines])
                grams.sort()
                starts = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
                self.grams.append(grams[starts])
                self.counts.append(np.diff(np.concatenate((starts, [len(grams)]))) if wanted else np.zeros(len(starts), dtype=np.int64))
        if sum(map(len, self.grams)) > 4_000_000:
            self.settle()
        self.raw, self.heads, self.held = [], [], 0

    def settle(self) -> None:
        grams, counts = _merge(self.grams, self.counts)
        self.grams, self.counts = [grams], [counts]

    def rows(self):
        self.pack()
        self.settle()
        grams, counts = self.grams[0], self.counts[0]
        for i, at in enumerate(range(0, len(grams), self.chunk)):
            keys = grams[at : at + self.chunk]
            yield self.number, _GRAMS, i, int(keys[0]), _pack_numbers(keys), _packed(counts[at : at + self.chunk].astype("<u4").tobytes())
        dealt: list[list[bytes]] = [[] for _ in range(self.word_parts)]
        for word in self.words.keys() | self.seen:
            dealt[zlib.crc32(word) % self.word_parts].append(word)
        for p, words in enumerate(dealt):
            if words:
                # \x0b is white space, so no word has it; the end token is a word here.
                yield self.number, _WORDS, p, 0, _packed(b"\x0b".join(words)), _packed(np.array([self.words.get(w, 0) for w in words], dtype="<i8").tobytes())
        for i, pack in enumerate(self.packs):
            yield self.number, _TEXTS, i, 0, pack, None


def _batches(rows, schema: T.StructType, types: list, most: int = 64):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=schema.names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=schema.names)


_PIECE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def pieces(df: DataFrame, training: Column, depth: int, word_parts: int, chunk: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of the table: packed texts, grams and words with their training counts."""

    def run(batches):
        def rows():
            context, n, block = TaskContext.get(), 0, None
            for batch in slices(batches, 1):
                for row_id, text, trains in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if block is None:
                        block = _Block((context.partitionId() << 32) + n, depth, word_parts, chunk)
                        n += 1
                    block.add(row_id, text, bool(trains))
                    if block.size >= BLOCK_BYTES:
                        yield from block.rows()
                        block = None
            if block is not None:
                yield from block.rows()

        yield from _batches(rows(), _PIECE, _PIECE_TYPES)

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.coalesce(training, F.lit(False)).alias("trains")).mapInArrow(run, _PIECE)


def _groups(batches, key_columns: int):
    """(key, rows) of consecutive rows with equal first columns."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:key_columns] != key:
                if held:
                    yield key, held
                key, held = row[:key_columns], []
            held.append(row)
    if held:
        yield key, held


def cuts_of(table: DataFrame, grams_per_part: int, chunk: int) -> list[int]:
    """Where the parts' ranges are cut: quantiles of the chunks' least grams, moved to the ends of short contexts."""
    chunks = table.where(F.col("kind") == _GRAMS)
    parts = -(-chunks.count() * chunk // grams_per_part)
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    return snapped(chunks.agg(F.percentile_approx("lo", shares, min(1_000_000, 20 * parts)).alias("c")).first()["c"])


def dealt(table: DataFrame, cuts: list[int]) -> DataFrame:
    """(part, block, keys, values): the chunks of all blocks, cut where the parts are."""
    shared = table.sparkSession.sparkContext.broadcast(np.array(cuts, dtype=np.uint64))

    def run(batches):
        def rows():
            for batch in batches:
                for block, keys, values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    grams = _unpack_numbers(keys)
                    first, last = np.searchsorted(shared.value, grams[[0, -1]], side="right").tolist()
                    if first == last:
                        yield first, block, keys, values
                        continue
                    counts = np.frombuffer(_unpacked(values), "<u4")
                    ends = [0, *np.searchsorted(grams, shared.value[first:last], side="left").tolist(), len(grams)]
                    for part, (a, b) in enumerate(zip(ends, ends[1:]), first):
                        if a < b:
                            yield part, block, _pack_numbers(grams[a:b]), _packed(counts[a:b].tobytes())

        yield from _batches(rows(), _DEALT, [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    return table.where(F.col("kind") == _GRAMS).select("block", "keys", "values").mapInArrow(run, _DEALT)


def _sum_grams(keys: list[bytes], values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return _merge([_unpack_numbers(k) for k in keys], [np.frombuffer(_unpacked(v), "<u4").astype(np.float64) for v in values])


def edge_nodes(parts: DataFrame, cuts: list[int], depth: int) -> DataFrame:
    """(part, depth, node, zeros, ones, stop): the whole tree's values of the nodes at each part's ends."""
    spark = parts.sparkSession
    nodes = "part int, depth int, node long, zeros double, ones double, stop double"
    if not cuts:
        return spark.createDataFrame([], nodes)
    shared = spark.sparkContext.broadcast(cuts)

    def sums(rows: pa.Table) -> pa.Table:
        part = rows.column("part")[0].as_py()
        grams, counts = _sum_grams(rows.column("keys").to_pylist(), rows.column("values").to_pylist())
        found = edge_sums(grams, counts, depth, edges_of(shared.value[max(part - 1, 0) : part + 1], depth))
        return pa.table([pa.array(np.full(len(found[0]), part, dtype=np.int32)), *map(pa.array, found)], names=["part", "depth", "node", "zeros", "ones", "below"])

    edges = written(parts.groupBy("part").applyInArrow(sums, _EDGE), "ctw-edges")
    levels = []
    for d in range(max((d for c in cuts for d in contexts_cut(c, depth)), default=-1), -1, -1):

        def weigh(batches, leaf=d == depth):
            for batch in batches:
                stop, weighted = weighed(*(np.asarray(batch.column(i)) for i in (1, 2, 3)), leaf)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(stop), pa.array(weighted)], names=["node", "zeros", "ones", "stop", "weighted"])

        rows = edges.where(F.col("depth") == d).select("node", "zeros", "ones", "below")
        if levels:
            # The parent's context lacks the farthest byte, the lowest of the child's.
            parent = F.shiftleft(F.shiftright("node", 19), 11).bitwiseOR(F.col("node").bitwiseAND(F.lit(0x7FF).cast("long")))
            rows = rows.unionByName(levels[-1].select(parent.alias("node"), F.lit(0.0).alias("zeros"), F.lit(0.0).alias("ones"), F.col("weighted").alias("below")))
        whole = rows.groupBy("node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below")))
        levels.append(written(whole.mapInArrow(weigh, "node long, zeros double, ones double, stop double, weighted double").withColumn("depth", F.lit(d)), f"ctw-level-{d}"))
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    return edges.select("part", "depth", "node").join(every, ["depth", "node"]).select("part", "depth", "node", "zeros", "ones", "stop")


def answers(table: DataFrame, cuts: list[int], depth: int) -> tuple[DataFrame, DataFrame]:
    """For each block's grams their log10 probabilities, for its words their counts, in the order of its keys."""
    shared = table.sparkSession.sparkContext.broadcast(cuts)
    parts = dealt(table, cuts)
    names = _PIECE.names

    def of_part(rows: pa.Table, nodes: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_batches([], pa.schema(list(zip(names, _PIECE_TYPES))))
        part, blocks, keys = rows.column("part")[0].as_py(), rows.column("block"), rows.column("keys").to_pylist()
        grams, counts = _sum_grams(keys, rows.column("values").to_pylist())
        at, known = np.asarray(nodes.column("depth")), {}
        columns = [np.asarray(nodes.column(c)) for c in ("node", "zeros", "ones", "stop")]
        for d in range(depth + 1):
            here = np.flatnonzero(at == d)
            here = here[np.argsort(columns[0][here])]
            known[d] = tuple(c[here] for c in columns)
        logs = log_probabilities(grams, counts, depth, edges_of(shared.value[max(part - 1, 0) : part + 1], depth), known)
        values = [_packed(logs[np.searchsorted(grams, _unpack_numbers(k))].astype("<f4").tobytes()) for k in keys]
        n = len(keys)
        same = [pa.array(np.full(n, x, dtype=t)) for x, t in ((_GRAMS, np.int32), (part, np.int32), (0, np.int64))]
        return pa.table([blocks, *same, rows.column("keys"), pa.array(values, pa.binary())], names=names)

    def run_words(batches):
        def rows():
            for (part,), found in _groups(batches, 1):
                totals: dict[bytes, int] = {}
                for r in found:
                    for word, n in zip(_unpacked(r[2]).split(b"\x0b"), np.frombuffer(_unpacked(r[3]), "<i8").tolist(), strict=True):
                        if n:
                            totals[word] = totals.get(word, 0) + n
                for _, block, keys, _ in found:
                    own = [totals.get(w, 0) for w in _unpacked(keys).split(b"\x0b")]
                    yield block, _WORDS, part, 0, keys, _packed(np.array(own, dtype="<i8").tobytes())
                # N and V of this part, as a row that belongs to no block
                yield -1, _WORDS, part, 0, None, struct.pack(">qq", sum(totals.values()), len(totals))

        yield from _batches(rows(), _PIECE, _PIECE_TYPES)

    of_grams = parts.groupBy("part").cogroup(edge_nodes(parts, cuts, depth).groupBy("part")).applyInArrow(of_part, _PIECE)
    words = table.where(F.col("kind") == _WORDS).select("part", "block", "keys", "values").repartition("part").sortWithinPartitions("part", "block")
    return of_grams, words.mapInArrow(run_words, _PIECE)


def scores(df: DataFrame, training: Column, depth: int = 6, grams_per_part: int = GRAMS_PER_PART, chunk_grams: int = CHUNK_GRAMS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, trained, n_bytes, n_tokens, n_known, train_tokens, train_types, base_score, score), one row for each input row.

    ``score`` / ``n_bytes`` times -log2(10) is the code length in bits a byte.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth is from 1 to 6: a gram is one signed 64-bit number")
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    table = written(pieces(df, training, depth, max(8, size // WORD_PART_BYTES), chunk_grams, id_col, text_col), "ctw-pieces")
    of_grams, of_words = answers(table, cuts_of(table, grams_per_part, chunk_grams), depth)
    of_words = written(of_words, "ctw-words")
    numbers = [F.conv(F.hex(F.substring("values", at, 8)), 16, 10).cast("long") for at in (1, 9)]
    train_tokens, train_types = (n or 0 for n in of_words.where("block = -1").select(F.sum(numbers[0]), F.sum(numbers[1])).first())
    schema = T.StructType(
        [
            T.StructField(id_col, T.StringType()),
            T.StructField("trained", T.BooleanType()),
            *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens", "n_known", "train_tokens", "train_types")),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    types = [pa.string(), pa.bool_(), *[pa.int64()] * 5, pa.float64(), pa.float64()]
    floor = float(train_tokens + train_types + 1)

    def score_pack(pack: bytes, grams: np.ndarray, values: np.ndarray, words: dict):
        raw = _unpacked(pack)
        (n,) = struct.unpack_from("<I", raw)
        ids, at = _unpacked_ids(raw, n, 4)
        nulls = np.frombuffer(raw, "u1", n, at).tolist()
        trains = np.frombuffer(raw, "u1", n, at + n).tolist()
        sizes = np.frombuffer(raw, "<u4", n, at + 2 * n).astype(np.int64)
        body = raw[at + 6 * n :]
        ends = np.cumsum(sizes)
        found = np.concatenate([grams_of(body[a:b], depth, END[0]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)])
        # In order, so that the search walks the grams once instead of jumping about in them.
        order = np.argsort(found)
        logs = np.empty(len(found))
        logs[order] = values[np.searchsorted(grams, found[order])]
        total = np.add.reduceat(logs, ends - sizes)
        for i, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
            counts = np.array([words[w] for w in body[a:b].split()] + [words[END]], dtype=np.float64)
            yield (None if nulls[i] else ids[i], bool(trains[i]), b - a, len(counts), int((counts > 0).sum()), train_tokens, train_types, float(np.log10((counts + 1) / floor).sum()), float(total[i]))

    def run(batches):
        def rows():
            block, keys, values, words, grams = None, [], [], {}, None
            for batch in batches:
                for number, kind, _, _, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if number != block:
                        block, keys, values, words, grams = number, [], [], {}, None
                    if kind == _GRAMS:
                        keys.append(_unpack_numbers(k))
                        values.append(np.frombuffer(_unpacked(v), "<f4"))
                    elif kind == _WORDS:
                        words.update(zip(_unpacked(k).split(b"\x0b"), np.frombuffer(_unpacked(v), "<i8").tolist(), strict=True))
                    else:
                        if grams is None:
                            grams, logs = np.concatenate(keys), np.concatenate(values).astype(np.float64)
                            order = np.argsort(grams)
                            grams, logs, keys, values = grams[order], logs[order], [], []
                        yield from score_pack(k, grams, logs, words)

        yield from _batches(rows(), schema, types, 4096)

    whole = of_grams.unionByName(of_words.where("block >= 0")).unionByName(table.where(F.col("kind") == _TEXTS))
    # As many partitions as there are blocks where these are more than the session's: a task then holds about one.
    blocks = size // BLOCK_BYTES
    by_block = whole.repartition(blocks, "block") if blocks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else whole.repartition("block")
    scored = by_block.sortWithinPartitions("block", "kind", "part").mapInArrow(run, schema)
    # Ids travel as texts and come back in their own type.
    return scored.withColumn(id_col, F.col(id_col).cast(df.schema[id_col].dataType))
