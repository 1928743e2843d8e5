"""SimHash near-duplicates found with BK-trees over shards of fingerprints.

A text's fingerprint has bit b set if more than half of its word shingles' 64-bit
hashes have it set.  Fingerprints link at ``radius`` or fewer differing bits, and
linked ones form components.

Search.  64 bits are cut into ``radius + 6`` bands; two fingerprints within the
radius agree on at least six bands, so each distinct fingerprint goes to one
shard for every choice of six bands.  A shard holds only fingerprints that agree
on those bands, so it has at most 2**(bits of the other bands) members (2**16 at
radius 2): a proven bound that doesn't grow with the corpus.  In a shard a
BK-tree (children keyed by their distance to the parent) finds each member's
earlier neighbours along the edges within the radius, and one link a member to
the least member it is joined with leaves the shard, never all pairs.

Trees are built where their shard's rows are, not sent from the driver: the
trees of all shards together grow with the corpus.

Defined results: null and word-less texts have fingerprint zero and link like any
other; exact copies share a fingerprint and meet as one member; a null id never
becomes a component's id unless all its rows have null ids; repeated rows give
repeated result rows; other columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.word_codes import slices
from tallyloom.llm.common import LOWER, written
from tallyloom.llm.components import components

SEED = 42


def shingle_hashes(text: str | None, words_in_shingle: int) -> np.ndarray:
    """XXH64 of every shingle of the lower-cased text, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    n = len(words) - words_in_shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[i : i + n] for i in range(words_in_shingle)), strict=True)
    return np.fromiter((digest(join(run), SEED) for run in runs), dtype=np.uint64, count=n)


def fingerprint(text: str | None, words_in_shingle: int) -> int:
    hashes = shingle_hashes(text, words_in_shingle)
    if not len(hashes):
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        block = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, words_in_shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the signed 64-bit value of each whole text's fingerprint."""
    schema = T.StructType([df.schema[id_col], T.StructField("fp", T.LongType(), False)])

    def run(batches):
        for batch in slices(batches, 1):
            found = np.array([fingerprint(t, words_in_shingle) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def bands(radius: int) -> list[int]:
    """Masks of the bands: 64 bits in radius + 6 nearly equal runs."""
    n = radius + 6
    edges = [64 * i // n for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def shard_masks(radius: int) -> list[int]:
    """For each choice of six bands, their bits (as signed 64-bit numbers)."""
    masks = [sum(choice) for choice in combinations(bands(radius), 6)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


class BkTree:
    """Integers by Hamming distance; a child hangs on the edge of its distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int, radius: int) -> list[int]:
        """Adds ``value``; the numbers of the earlier members within the radius."""
        number = len(self.values)
        near: list[int] = []
        if number:
            stack = [0]
            while stack:
                node = stack.pop()
                distance = (self.values[node] ^ value).bit_count()
                if distance <= radius:
                    near.append(node)
                below = self.children[node]
                if len(below) <= 2 * radius + 1:
                    stack += [child for edge, child in below.items() if -radius <= edge - distance <= radius]
                else:
                    stack += [below[e] for e in range(distance - radius, distance + radius + 1) if e in below]
            node = 0
            while True:
                distance = (self.values[node] ^ value).bit_count()
                following = self.children[node].setdefault(distance, number)
                if following == number:
                    break
                node = following
        self.values.append(value)
        self.children.append({})
        return near


def links_of_shard(members: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, least member of its group in the shard); ``members`` are distinct and ascending."""
    tree, root = BkTree(), list(range(len(members)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(members):
        for j in tree.add(value, radius):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return [(members[i], members[r]) for i in range(len(members)) if (r := find(i)) != i]


def shard_links(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b) links between distinct fingerprints ``fp``, enough to join what is within the radius."""
    wide = 1 << 64
    schema = "a long, b long"
    masks = F.array(*[F.struct(F.lit(i).alias("choice"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(shard_masks(radius))])
    dealt = distinct.select("fp", F.explode(masks).alias("m")).select(F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("shared"), "fp")

    def links(choice, shared, fp):
        """Links of all shards in sorted columns; shards of one are passed over in one step."""
        starts = np.flatnonzero(np.concatenate(([True], (np.diff(choice) != 0) | (shared[1:] != shared[:-1]))))
        ends = np.concatenate((starts[1:], [len(fp)]))
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
            members = [int(x) % wide for x in fp[a:b].tolist()]
            yield from links_of_shard(sorted(members), radius)

    def signed(numbers):
        return pa.array(np.array(numbers, dtype=np.uint64).view(np.int64))

    def run(batches):
        held = None  # the last shard so far: it may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(c) for c in batch.columns]
            if held is not None:
                columns = [np.concatenate(pair) for pair in zip(held, columns)]
            choice, shared, fp = columns
            last = len(fp) - 1
            cut = np.flatnonzero((choice != choice[last]) | (shared != shared[last]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                found = list(links(choice[:cut], shared[:cut], fp[:cut]))
                if found:
                    yield pa.RecordBatch.from_arrays([signed([x[i] for x in found]) for i in (0, 1)], names=["a", "b"])
            held = [c[cut:] for c in columns]
        if held is not None and (found := list(links(*held))):
            yield pa.RecordBatch.from_arrays([signed([x[i] for x in found]) for i in (0, 1)], names=["a", "b"])

    return dealt.repartition("choice", "shared").sortWithinPartitions("choice", "shared").mapInArrow(run, schema)


def grouped(docs: DataFrame, distinct: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """(id, fp, component_id) of ``docs`` (id, fp), given links between its ``distinct`` fingerprints (fp, least_id)."""
    roots = components(links)
    members = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    members = written(members, "members")
    groups = written(members.groupBy("root").agg(F.min("least_id").alias("component_id")), "groups")
    by_fp = written(members.select("fp", "root").join(groups, "root").select("fp", "component_id"), "component-of")
    return docs.join(by_fp, "fp").select(id_col, "fp", "component_id")


def near_duplicates(df: DataFrame, words_in_shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id): the least id that links reach, one row for each input row."""
    docs = written(fingerprints(df, words_in_shingle, id_col, text_col), "fingerprints")
    distinct = written(docs.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct")
    return grouped(docs, distinct, shard_links(distinct, radius), id_col)
