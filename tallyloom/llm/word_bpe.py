"""Word BPE encoding and decoding with a contiguous rank array.

A word's symbols lie side by side, and beside them the merge rank of each
adjacent pair.  The least rank is found by scanning the array, its boundary is
deleted, and the ranks of the two pairs that touch the new symbol are looked up
again; no queue and no list of links.  For words of usual length the arrays fit
in a few cache lines, so a scan beats any structure.  A piece of more than
``LONG`` symbols is held in NumPy arrays, and a scan deletes all boundaries of
the least rank at once: a merge makes no pair of its own or a lower rank where
every merge ranks above those that make its parts, which is checked on loading.

White space is never part of a token in such a file, so texts are cut there,
each distinct word of a batch is coded once, and the words' ids are gathered.
Normal form and pre-token pattern are the file's; words of ASCII alone go
through Python's own equivalents, all others through the library's.

Defined results: a null text is read as empty; an empty text has no ids and
decodes to an empty text, as does a null id list; ids outside the vocabulary
raise.  Literal added tokens get their own ids.  Rows are independent, so
repeated rows and ties in the id column don't matter.  ``encode`` reads the id
and text columns only; ``decode`` keeps all columns but one that has the name of
its result, which is replaced.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.word_codes import BATCH_BYTES, slices

#: Symbols from which a piece is merged in NumPy arrays.
LONG = 400

#: Rank of a pair that no merge joins.
NONE = 1 << 30

#: The steps of the file kind that is read here, as the file writes them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PIECES = [
    {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]

#: PATTERN for lower-case ASCII without white space.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9 ]+")

#: A control character that stands between words that go through the library together.
BETWEEN = "\x02"


def checked(spec: dict) -> dict:
    """The file's content, if it is of the kind whose rules are built here."""
    model, added = spec["model"], spec.get("added_tokens", [])
    plain = (
        model["type"] == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        and (spec.get("normalizer") or {}).get("normalizers") == NORMAL
        and (spec.get("pre_tokenizer") or {}).get("pretokenizers") == PIECES
        and spec.get("post_processor") is None
        and spec.get("decoder") is None
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in added)
    )
    if not plain:
        raise ValueError("the tokenizer file has steps that word_bpe doesn't build")
    return spec


class RankArray:
    """Merges the symbols of words by the ranks of adjacent pairs."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        """``merges`` has left symbol, right symbol and joined symbol, the first ranked lowest."""
        self.joined = [c for _, _, c in merges]
        self.pairs = {a << 20 | b: rank for rank, (a, b, _) in enumerate(merges)}
        made = {c: rank for rank, c in enumerate(self.joined)}
        self.rising = len(made) == len(merges) and all(max(made.get(a, -1), made.get(b, -1)) < rank for rank, (a, b, _) in enumerate(merges))
        keys = np.fromiter(self.pairs, np.int64, len(self.pairs))
        order = np.argsort(keys)
        self.keys, self.key_ranks = np.append(keys[order], 1 << 62), np.append(np.fromiter(self.pairs.values(), np.int64, len(self.pairs))[order], NONE)

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols that are left when no adjacent pair has a rank; of equal ranks the leftmost goes first."""
        if len(symbols) > LONG and self.rising:
            return self._merged_long(symbols)
        rank_of = self.pairs.get
        ranks = [rank_of(a << 20 | b, NONE) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            at = ranks.index(low)
            symbols[at : at + 2] = (self.joined[low],)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(symbols[at] << 20 | symbols[at + 1], NONE)
            if at:
                ranks[at - 1] = rank_of(symbols[at - 1] << 20 | symbols[at], NONE)
        return symbols

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE)

    def _merged_long(self, symbols: list[int]) -> list[int]:
        parts = np.array(symbols, dtype=np.int64)
        ranks = self._ranks(parts[:-1], parts[1:])
        while len(ranks) and (low := int(ranks.min())) != NONE:
            at = np.flatnonzero(ranks == low)
            # Neighbouring places share a symbol (as in "aaa"): every other one of such a run is merged.
            fresh = np.diff(at, prepend=-2) != 1
            nth = np.arange(len(at))
            at = at[(nth - np.maximum.accumulate(np.where(fresh, nth, 0))) % 2 == 0]
            parts[at] = self.joined[low]
            keep = np.ones(len(parts), dtype=bool)
            keep[at + 1] = False
            parts = parts[keep]
            keep = np.ones(len(ranks), dtype=bool)
            keep[at] = False
            ranks = ranks[keep]
            moved = at - np.arange(len(at))
            touched = np.concatenate([moved[moved < len(ranks)], moved[moved > 0] - 1])
            ranks[touched] = self._ranks(parts[touched], parts[touched + 1])
        return parts.tolist()


class WordBpe:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = checked(json.load(f))
        library = Tokenizer.from_file(path)
        self.normal, self.pieces_of = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        vocabulary, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        halves = ((m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"])
        self.array = RankArray([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in halves])
        self.inner = {c: i for c, i in vocabulary.items() if len(c) == 1}
        self.last = {c: vocabulary[c + suffix] for c in self.inner if c + suffix in vocabulary}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        literal = sorted(self.added, key=len, reverse=True)
        self.literal = re.compile("(" + "|".join(map(re.escape, literal)) + ")") if literal else None
        self.between = self.pieces_of(BETWEEN)[0][0]
        words = vocabulary | self.added
        self.tokens = [""] * (max(words.values(), default=-1) + 1)
        for token, i in words.items():
            self.tokens[i] = token
        self.known = np.zeros(len(self.tokens), dtype=bool)
        self.known[list(words.values())] = True

    def code(self, piece: str) -> bytes:
        """Ids of one pre-token, little-endian 32 bits each."""
        symbols = [self.inner[c] for c in piece[:-1]]
        symbols.append(self.last[piece[-1]])
        return array("I", self.array.merged(symbols)).tobytes()

    def cut(self, words: list[str]) -> Iterator[list[str]]:
        """Each word's pre-tokens; the words hold no ASCII white space."""
        odd = [w for w in words if not w.isascii()]
        joint = [w for w in odd if BETWEEN not in w]
        of_joint, held = [], []
        for piece, _ in self.pieces_of(self.normal(f" {BETWEEN} ".join([*joint, ""]))) if joint else ():
            if piece == self.between:
                of_joint.append(held)
                held = []
            else:
                held.append(piece)
        if len(of_joint) != len(joint):
            raise ValueError("the pattern joins words")
        of_joint = iter(of_joint)
        # Control characters go by other names at the byte level, printable ones by their own.
        plain = ((w, ASCII_PIECES.findall(w.lower())) for w in words if w.isascii() and w.isprintable())
        found = dict(plain)
        for word in words:
            if word in found:
                yield found[word]
            elif word.isascii() or BETWEEN in word:
                yield [p for p, _ in self.pieces_of(self.normal(word))]
            else:
                yield next(of_joint)

    def codes_of(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, little-endian 32 bits each."""
        split = {w: self.literal.split(w) for w in words if self.literal.search(w)} if self.literal else {}
        whole = [w for w in words if w not in split]
        whole += [part for parts in split.values() for part in parts if part not in self.added]
        cut = dict(zip(whole, self.cut(whole)))
        code = {p: self.code(p) for p in {p for pieces in cut.values() for p in pieces}}
        made = {w: b"".join([code[p] for p in pieces]) for w, pieces in cut.items()}
        for word, parts in split.items():
            made[word] = b"".join(array("I", [self.added[p]]).tobytes() if p in self.added else made[p] for p in parts)
        return [made[w] for w in words]

    def encode(self, texts: pa.Array) -> pa.ListArray:
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        starts = np.asarray(lists.offsets)
        words = lists.values.dictionary_encode()
        codes = pa.array(self.codes_of(words.dictionary.to_pylist()), pa.binary()).take(words.indices)
        offsets = np.frombuffer(codes.buffers()[1], dtype=np.int32, count=len(codes) + 1) if len(codes) else np.zeros(1, np.int32)
        data = codes.buffers()[2]
        ids = np.frombuffer(data, dtype="<i4", count=int(offsets[-1]) // 4) if offsets[-1] else np.empty(0, "<i4")
        return pa.ListArray.from_arrays(pa.array(offsets[starts] // 4, pa.int32()), pa.array(ids, pa.int32()))

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """The tokens of each list with a space between them, as a file without a decoder has it."""
        ids = np.asarray(lists.values)
        if len(ids) and not ((ids >= 0) & (ids < len(self.known)) & self.known[np.clip(ids, 0, len(self.known) - 1)]).all():
            raise ValueError("an id is outside the vocabulary")
        tokens = pa.array(self.tokens, pa.string()).take(lists.values)
        return pc.fill_null(pc.binary_join(pa.ListArray.from_arrays(lists.offsets, tokens), " "), "")


_LOADED: dict[str, WordBpe] = {}


def codec(path: str) -> WordBpe:
    """One codec for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``ids array<int>`` of every whole text; one row for each input row."""
    schema = T.StructType([df.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_file)
        for batch in slices(batches, 1, BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column(0), bpe.encode(batch.column(1))], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer_file: str, ids_col: str = "ids") -> DataFrame:
    """All columns of ``df`` and ``decoded string``, the text of its id lists."""
    df = df.select(*(c for c in df.columns if c.lower() != "decoded")).withColumn(ids_col, F.coalesce(ids_col, F.array().cast("array<int>")))
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType(), False)])
    at, names = df.columns.index(ids_col), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer_file)
        for batch in slices(batches, at):
            lists = batch.column(at)
            lists = pa.ListArray.from_arrays(pa.array(np.asarray(lists.offsets) - lists.offsets[0].as_py(), pa.int32()), lists.flatten())
            yield pa.RecordBatch.from_arrays([*batch.columns, bpe.decode(lists)], names=names)

    return df.mapInArrow(run, schema)
