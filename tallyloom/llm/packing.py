"""Best-fit-decreasing packing of tokenised documents into fixed windows.

Every document becomes its token ids and one end id.  A document longer than a
window is first cut into full windows; what remains is placed, longest first,
into the open window whose free space fits it most tightly.  A segment tree
indexed by remaining capacity finds that window in log2(window) steps.

Documents are packed in the task that tokenises them, ``docs_per_shard`` at a
time in the order in which they are read, so nothing is shuffled, copies of a text
weigh no more than other rows, and a task holds the remainders of one shard only
(less than a window of ids each).  The price is about one partly filled window a
shard.  Sequence ids are unique: the partition's number times 2**36 plus the
window's number in the partition.

Defined results: a null text is read as empty; an empty text is one piece that
holds the end id only; ties in length go by the order of reading; repeated rows
are packed as separate documents; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.word_codes import BATCH_BYTES, WordCodes, slices

#: Unicode characters that stand for bytes in byte-level vocabularies: printable
#: Latin-1 characters stand for themselves, the others follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class CapacityTree:
    """Open windows by free space; ``tightest(n)`` finds the least space of at least n.

    Leaf c counts the open windows with c tokens free, an inner node its leaves.
    """

    def __init__(self, window: int):
        self.size = 1
        while self.size < window + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.at: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        node = self.size + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def open(self, capacity: int, sequence: int) -> None:
        self.at[capacity].append(sequence)
        self._add(capacity, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least free space >= need: (space, sequence)."""
        count, node = self.count, self.size + need
        if not count[node]:
            # Up until a right sibling has a window, then down its leftmost path.
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.size
        self._add(capacity, -1)
        return capacity, self.at[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; pieces are placed longest first, ties in given order."""
    tree, placed, sequences = CapacityTree(window), [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        n = lengths[i]
        found = tree.tightest(n)
        if found is None:
            space, sequence = window, sequences
            sequences += 1
        else:
            space, sequence = found
        placed[i] = (sequence, window - space)
        if space > n:
            tree.open(space - n, sequence)
    return placed


class Ids:
    """Ids of whole texts by a byte-level ``tokenizers`` file, as little-endian 32-bit numbers.

    With ``added_tokens``, texts that hold one of the file's added tokens go to the library, which gives it its own id.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        step = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") is not None or any(step.get(k, v) != v for k, v in BYTE_LEVEL.items()) or step.get("type") != "ByteLevel":
            raise ValueError("the tokenizer file has a normalizer or pre-token step that packing doesn't build")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if added_tokens else []
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
        self.codes = WordCodes(regex.compile(pattern), self._pieces)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        mapped = [p.encode().decode("latin-1").translate(BYTE_CHARS) for p in pieces]
        return [array("I", [t.id for t in self.tokenize(m)]).tobytes() for m in mapped]

    def encode(self, texts: pa.Array) -> list[bytes]:
        held = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            held |= np.asarray(pc.fill_null(pc.match_substring(texts, token), False))
        whole = {int(i): texts[i].as_py() for i in np.flatnonzero(held)}
        ids, starts = self.codes.encode(texts.filter(pa.array(~held)) if whole else texts)
        data, ends = ids.tobytes(), (4 * starts).tolist()
        coded = iter([data[a:b] for a, b in zip(ends, ends[1:])])
        return [array("I", self.tokenizer.encode(whole[i], add_special_tokens=False).ids).tobytes() if i in whole else next(coded) for i in range(len(texts))]


_LOADED: dict[tuple[str, bool], Ids] = {}


def _ids(path: str, added_tokens: bool) -> Ids:
    if (path, added_tokens) not in _LOADED:
        _LOADED[path, added_tokens] = Ids(path, added_tokens)
    return _LOADED[path, added_tokens]


class _Rows:
    """Pieces that wait to be handed on: rows of an id column beside lists of the other columns."""

    def __init__(self):
        self.ids, self.lists = [], [[] for _ in range(6)]

    def batch(self, names: list[str]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.concat_arrays(self.ids), *(pa.array(x, k) for x, k in zip(self.lists, kinds))], names=names)


#: Partitions are joined until one has so many documents or bytes on average, else each would leave a window open for a few.
LEAST_DOCS, LEAST_BYTES = 512, 1 << 20

#: Fixed value: the pre-token step of the file kind that is read here, as the file writes it.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def pack(
    df: DataFrame,
    tokenizer_file: str,
    window: int = 1024,
    end_id: int = 0,
    docs_per_shard: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    added_tokens: bool = False,
) -> DataFrame:
    """One row for each piece: id, start, length, ids (binary, little-endian 32 bits each), doc_tokens, sequence_id, offset.

    A literal such as ``<|endoftext|>`` in a text is plain text, or with ``added_tokens`` the file's own token.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, df.schema[id_col].dataType),
            T.StructField("start", T.LongType(), False),
            T.StructField("length", T.LongType(), False),
            T.StructField("ids", T.BinaryType(), False),
            T.StructField("doc_tokens", T.LongType(), False),
            T.StructField("sequence_id", T.LongType(), False),
            T.StructField("offset", T.LongType(), False),
        ]
    )
    end = array("I", [end_id]).tobytes()

    def full_windows(ids: pa.Array, coded: list[bytes], sequence: int) -> Iterator[pa.RecordBatch]:
        out, owners = _Rows(), []
        for row, code in enumerate(coded):
            n = len(code) // 4
            for start in range(0, n - window + 1, window):
                owners.append(row)
                for column, value in zip(out.lists, (start, window, code[4 * start : 4 * (start + window)], n, sequence, 0)):
                    column.append(value)
                sequence += 1
        if owners:
            out.ids = [ids.take(pa.array(owners, pa.int64()))]
            yield out.batch(schema.names)

    def remainders(ids: pa.Array, coded: list[bytes], into: _Rows) -> None:
        owners = []
        for row, code in enumerate(coded):
            n = len(code) // 4
            if left := n % window:
                owners.append(row)
                for column, value in zip(into.lists, (n - left, left, code[4 * (n - left) :], n)):
                    column.append(value)
        into.ids.append(ids.take(pa.array(owners, pa.int64())))

    def placed(held: _Rows, sequence: int) -> pa.RecordBatch:
        for at, offset in best_fit_decreasing(held.lists[1], window):
            held.lists[4].append(sequence + at)
            held.lists[5].append(offset)
        return held.batch(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ids(tokenizer_file, added_tokens)
        sequence, held = TaskContext.get().partitionId() << 36, _Rows()
        for batch in slices(batches, 1, BATCH_BYTES):
            for at in range(0, batch.num_rows, docs_per_shard):
                part = batch.slice(at, docs_per_shard)
                coded = [c + end for c in coder.encode(part.column(1))]
                for rows in full_windows(part.column(0), coded, sequence):
                    sequence += rows.num_rows
                    yield rows
                remainders(part.column(0), coded, held)
                if len(held.lists[0]) >= docs_per_shard:
                    rows = placed(held, sequence)
                    sequence += rows.num_rows
                    yield rows
                    held = _Rows()
        if held.lists[0]:
            yield placed(held, sequence)

    docs = df.select(id_col, text_col)
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()
    return docs.coalesce(max(1, n // LEAST_DOCS, size // LEAST_BYTES)).mapInArrow(run, schema)
