"""Token ids of whole texts, word by word.

The usual pre-token patterns join at most one space to the word after it and
never a word to what follows a space, so a text may be cut before every single
space that stands between two other characters, and each part coded by itself.
Texts are coded in batches: Arrow numbers a batch's distinct words, each of them
is cut into pre-tokens and coded once, and the words' ids are then gathered.
Nothing is kept from batch to batch, so memory is bounded by the batch.
"""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: Bytes of text that are coded together; a longer text is a batch of its own.
BATCH_BYTES = 4 << 20

#: A space that follows white space, as Python sees it (all that Unicode has and four separators), in RE2's words.
SPACE_AFTER_SPACE = r"[\t-\r\x1c-\x1f\x{85}\p{Z}] "
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def words_of(texts: pa.Array) -> pa.ListArray:
    """Each text cut at single spaces: all words but the first are meant with the space before them."""
    odd = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, SPACE_AFTER_SPACE)))
    if not len(odd):
        return pc.split_pattern(texts, " ")
    rest = np.delete(np.arange(len(texts)), odd)
    cut = pa.array([LONE_SPACE.split(t) for t in texts.take(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
    place = np.empty(len(texts), dtype=np.int64)
    place[rest], place[odd] = np.arange(len(rest)), len(rest) + np.arange(len(odd))
    return pa.concat_arrays([pc.split_pattern(texts.take(pa.array(rest)), " "), cut]).take(pa.array(place))


class WordCodes:
    """Ids of texts by a pre-token pattern and a function from pre-tokens to ids (little-endian, 32 bits each)."""

    def __init__(self, pattern: regex.Pattern, code_pieces: Callable[[list[str]], list[bytes]]):
        self.find, self.code_pieces = pattern.findall, code_pieces

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one more than there are texts)."""
        lists = words_of(pc.fill_null(texts, ""))
        starts = np.asarray(lists.offsets)
        words = lists.values.dictionary_encode()
        firsts = lists.values.take(pa.array(starts[:-1])).to_pylist()
        codes = pa.array(self.codes_of(words.dictionary.to_pylist(), firsts), pa.binary())
        which = np.array(words.indices)
        which[starts[:-1]] = len(words.dictionary) + np.arange(len(firsts))
        taken = codes.take(pa.array(which))
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int32, count=len(taken) + 1)
        ids = np.frombuffer(taken.buffers()[2], dtype="<u4", count=int(offsets[-1]) // 4) if len(taken) and offsets[-1] else np.empty(0, "<u4")
        return ids, offsets[starts] // 4

    def codes_of(self, words: list[str], firsts: list[str]) -> list[bytes]:
        """Codes of ``words``, each with a space before it, then of ``firsts`` as they stand."""
        # A word of letters is one pre-token; one that ends in white space would run into the next if both were cut up together.
        joint = [w for w in words if not w.isalpha() and w and not w[-1].isspace()]
        apart = [w for w in words if not w or w[-1].isspace()]
        pieces = self.find(" " + " ".join(joint)) if joint else []
        of_apart, of_first = [self.find(" " + w) for w in apart], [self.find(w) for w in firsts]
        letters = [" " + w for w in words if w.isalpha()]
        new = list({*letters, *pieces, *chain.from_iterable(of_apart), *chain.from_iterable(of_first)})
        code = dict(zip(new, self.code_pieces(new)))
        made = {w: b"".join([code[p] for p in found]) for w, found in zip(apart, of_apart)}
        at = iter(pieces)
        for word in joint:
            parts, left = [], len(word) + 1
            while left > 0:
                piece = next(at)
                left -= len(piece)
                parts.append(code[piece])
            if left:
                raise ValueError("the pattern joins what a single space parts")
            made[word] = b"".join(parts)
        out = [code[" " + w] if w.isalpha() else made[w] for w in words]
        return out + [b"".join([code[p] for p in found]) for found in of_first]


def give_back() -> None:
    """Returns what a worker has freed to the system: workers live on from task to task, and their stages' peaks would add up."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes in one string or binary column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(limit, batch.column(column).nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)
    give_back()
