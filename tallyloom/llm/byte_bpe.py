"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Pre-tokens are laid end to end in one linked list of byte symbols, with a
separator between them that no pair joins.  Every adjacent pair whose joined
bytes have a merge rank puts its left position into that rank's bucket; a
two-level bitmap over the ranks marks the buckets in use, so the lowest pending
rank is found by two find-first-set steps however long the list is.  A bucket is
taken whole and walked from left to right; an entry whose pair has changed
meanwhile is stale and is skipped when it is met.  Work is O(n log n) for n bytes
(the log sorts buckets) where every merge ranks above those that make its parts, as
in trained files; ranks in another order give the same ids, but a bucket is cut and
sorted again for each lower rank that comes up.  The usual rescan is O(n^2).  What a
rank's bucket costs to find is shared by all pre-tokens of the list.

Defined results: a null text is read as empty; an empty text has no ids and
decodes to no bytes; a null id list decodes to no bytes; ids outside the
vocabulary raise.  Rows are independent, so repeated rows and ties in the id
column don't matter.  ``encode`` reads the id and text columns only; ``decode``
keeps all columns but one that has the name of its result, which is replaced.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyloom.llm.word_codes import BATCH_BYTES, WordCodes, slices


#: Bytes of pre-tokens that share a linked list.
LIST_BYTES = 1 << 20


class RankQueue:
    """Merges the bytes of many pre-tokens by one table of ranks.

    ``pairs`` has the rank of each pair of symbols that may be joined, by
    left symbol * 2**20 + right symbol.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.separator = max(ranks.values(), default=0) + 1
        self.pairs = {}
        for token, rank in ranks.items():
            for at in range(1, len(token)):
                left, right = ranks.get(token[:at]), ranks.get(token[at:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        self.first = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        of_two = np.full((257, 257), -1, dtype=np.int32)  # row and column 256 stand for the separator
        of_two[:256, :256] = [[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)]
        self.of_two = of_two

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """Each pre-token's ids as little-endian 32-bit numbers."""
        whole = [self.ranks.get(p) for p in pieces]
        merged = self._by_lists([p for p, w in zip(pieces, whole) if w is None])
        return [next(merged) if w is None else w.to_bytes(4, "little") for w in whole]

    def _by_lists(self, pieces: list[bytes]) -> Iterator[bytes]:
        """Pre-tokens in lists of about ``LIST_BYTES``; a longer one has a list to itself."""
        held, size = [], 0
        for piece in pieces:
            if held and size + len(piece) > LIST_BYTES:
                yield from self._merged(held)
                held, size = [], 0
            held.append(piece)
            size += len(piece)
        yield from self._merged(held)

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        n = len(data) + len(pieces) + 1
        breaks = np.zeros(len(pieces) + 1, dtype=np.int64)
        np.cumsum(sizes + 1, out=breaks[1:])
        code = np.full(n, 256, dtype=np.int64)
        code[np.delete(np.arange(n), breaks)] = data
        symbols = np.append(self.first, self.separator)[code].astype(np.int32)
        if (symbols < 0).any():
            raise ValueError("the ranks lack a single byte of the text")
        ranks = np.append(self.of_two[code[:-1], code[1:]], np.int32(-1))
        waiting = np.flatnonzero(ranks >= 0)
        order = waiting[np.argsort(ranks[waiting], kind="stable")]
        used, starts = np.unique(ranks[order], return_index=True)
        self._drain(n, symbols, ranks, used.tolist(), order.tolist(), [*starts.tolist(), len(order)])
        left = symbols[symbols >= 0]
        ends = (4 * np.flatnonzero(left == self.separator)).tolist()
        ids = left.astype("<i4").tobytes()
        return [ids[a + 4 : b] for a, b in zip(ends, ends[1:])]

    def _drain(self, n: int, symbols: np.ndarray, ranks: np.ndarray, used: list[int], order: list[int], starts: list[int]) -> None:
        """Merges until no bucket is left; a symbol that went into the one before it becomes -1 in ``symbols``."""
        find = self.pairs.get
        symbol, pending = array("i", symbols.tobytes()), array("i", ranks.tobytes())
        after = array("i", np.arange(1, n + 1, dtype=np.int32).tobytes())
        before = array("i", np.arange(-1, n - 1, dtype=np.int32).tobytes())
        buckets = {rank: order[a:b] for rank, a, b in zip(used, starts, starts[1:])}
        words, top = [0] * ((self.separator >> 8) + 1), 0
        for rank in used:
            words[rank >> 8] |= 1 << (rank & 255)
            top |= 1 << (rank >> 8)
        while top:
            a = (top & -top).bit_length() - 1
            word = words[a]
            rank = (a << 8) + (word & -word).bit_length() - 1
            words[a] = word = word & (word - 1)
            if not word:
                top &= top - 1
            bucket = buckets.pop(rank)
            bucket.sort()
            shifted = rank << 20
            for i in bucket:
                if pending[i] != rank:
                    continue  # stale: the pair at i has gone or changed
                j = after[i]
                k = after[j]
                symbol[i], symbol[j], pending[j] = rank, -1, -1
                after[i], before[k] = k, i
                h = before[i]
                new = pending[i] = find(shifted | symbol[k], -1)
                other = find(symbol[h] << 20 | rank, -1)
                if new >= 0:
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        words[new >> 8] |= 1 << (new & 255)
                        top |= 1 << (new >> 8)
                if other != pending[h]:
                    pending[h] = other
                    if other >= 0:
                        if other in buckets:
                            buckets[other].append(h)
                        else:
                            buckets[other] = [h]
                            words[other >> 8] |= 1 << (other & 255)
                            top |= 1 << (other >> 8)
                if -1 < new < rank or -1 < other < rank:
                    # A lower rank has come up: it goes first, the bucket waits.
                    buckets[rank] = bucket[bucket.index(i) + 1 :]
                    words[rank >> 8] |= 1 << (rank & 255)
                    top |= 1 << (rank >> 8)
                    break
        symbols[:] = np.frombuffer(symbol, dtype=np.int32)


class ByteBpe:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        # White space as Unicode has it; \s of Python also takes the separators \x1c to \x1f.
        pattern = pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
        self.vocabulary = {v: k for k, v in self.ranks.items()}
        self.codes = WordCodes(regex.compile(pattern), lambda pieces: self.queue.encode([p.encode() for p in pieces]))

    @cached_property
    def queue(self) -> RankQueue:
        """Made when it is first needed: tasks that only decode do without."""
        return RankQueue(self.ranks)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Each text's ids, without making Python numbers of them."""
        ids, starts = self.codes.encode(texts)
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.view("<i4"), pa.int32()))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


_LOADED: dict[tuple, ByteBpe] = {}


def codec(rank_file: str, pattern: str) -> ByteBpe:
    """One codec for each worker process and vocabulary."""
    key = (rank_file, pattern)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(rank_file, pattern)
    return _LOADED[key]


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every whole text; one row for each input row."""
    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        for batch in slices(batches, 1, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.encode(batch.column(1))], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``decoded binary``, the bytes of its id lists."""
    df = df.select(*(c for c in df.columns if c.lower() != "decoded"))
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType(), False)])
    at, names = df.columns.index(ids_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(rank_file, pattern)
        for batch in slices(batches, at):
            lists = batch.column(at)
            values, offsets = np.asarray(lists.values), np.asarray(lists.offsets).tolist()
            decoded = [bpe.decode(values[a:b].tolist()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], names=names)

    return df.mapInArrow(run, schema)
