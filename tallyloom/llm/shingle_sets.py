"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The search is complete and every link is checked on the whole sets.

1. Of each distinct set the leading hashes are looked at: the first n - ceil(4n/5)
   + l(n) in order of value, l(n) = ceil(n/10).  Two similar sets of at least
   ceil(4n/5) shingles each have l of the smaller one or more in common there, so a
   set of which fewer leading hashes stand in another set has no partner.
2. The other sets are read again in full.  Among the sets that meet on one of six
   minimum hashes all similar pairs are found, by what each set has and lacks
   against the shingles that most of them have; the links that are kept connect
   what the pairs do, so there are fewer of them than sets.
3. Shingles are ordered by the number of sets that have them, then by value.
   Similar sets share one among their first n - ceil(4n/5) + 1, and at the first one
   that they share enough are left on both sides.  Each pair that shares such a one,
   may agree in size, met on no minimum hash and isn't joined yet is compared.

Near copies of one text meet in step 2 almost all, so step 3 makes few pairs of a
large group of them.  What meets on a minimum hash or on a shingle (there by bands
of set sizes) is dealt to tasks in blocks of bounded size, so that each two sets
meet in one task; nothing is left out.

Defined results: a text of one to four words is one shingle; null and word-less
texts have no set and no link here; a set's texts link to each other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.llm.common import released, small, written
from tallyloom.llm.components import components
from tallyloom.llm.simhash import fingerprint, grouped, shard_links, shingle_hashes
from tallyloom.llm.word_codes import slices

WORDS = 5
#: Odd factors that give the six minimum hashes: multiples of one by odd numbers, modulo 2**64.
KEYS = tuple(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) for i in range(6))
#: Shingles, and sets, of a group that one block holds; a task compares two blocks.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 20, 4096
#: Sizes of similar sets differ by a factor of 1.25 at most, so by one band at most.
BAND = 1.26


def shared_least(n: int) -> int:
    """Shingles that a similar set must share with one of n: ceil(4n/5)."""
    return -(-4 * n // 5)


def _more(n: int) -> int:
    return max(1, -(-n // 10))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two arrays of distinct hashes is 4/5 or more."""
    if 4 * max(len(a), len(b)) > 5 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    values = np.concatenate([*arrays, np.empty(0, dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    values, ends = np.asarray(column.values), np.asarray(column.offsets)
    return [values[a:b] for a, b in zip(ends, ends[1:])]


def text_sets(df: DataFrame, whole: bool, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, key, n, d1, d2, hashes): fingerprint, hash of the text, size, digests and leading (or all) hashes of its set."""
    names = ["fp", "key", "n", "d1", "d2"]
    schema = T.StructType([df.schema[id_col], *(T.StructField(c, T.LongType()) for c in names), T.StructField("hashes", T.ArrayType(T.LongType(), False))])

    def run(batches):
        for batch in slices(batches, 1):
            rows, sets = [], []
            for text, key in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hashes = np.unique(shingle_hashes(text, WORDS))
                n, digest = len(hashes), xxhash.xxh3_128_digest(hashes.tobytes())
                d1, d2 = np.frombuffer(digest, dtype=np.int64).tolist()
                fp = int(np.uint64(fingerprint(text, 3)).view(np.int64))
                rows.append((fp, key, n, d1, d2))
                sets.append((hashes if whole else hashes[: n - shared_least(n) + _more(n)]).view(np.int64))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, _lists(sets)], names=schema.names)

    return df.select(id_col, text_col, F.xxhash64(text_col).alias("key")).mapInArrow(run, schema)


def distinct_sets(rows: DataFrame) -> DataFrame:
    """(sid, n, key, at, fp, hashes): one row for each distinct set, with its least fingerprint and the id and hash of one text."""
    one = F.min(F.struct(F.col(rows.columns[0]).alias("at"), "key")).alias("one")
    found = rows.where("n > 0").groupBy("n", "d1", "d2").agg(one, F.min("fp").alias("fp"), F.first("hashes").alias("hashes"))
    # Numbered as it is written: of a task's attempts one is kept, so numbers are what they are in the table.
    return written(found.select(F.monotonically_increasing_id().alias("sid"), "n", "one.key", "one.at", "fp", "hashes"), "sets")


def _runs(batches, of: int):
    """Columns of all rows that agree on the first ``of`` columns, run by run, from sorted batches."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(c) for c in batch.columns]
        change = np.zeros(len(columns[0]) - 1, dtype=bool)
        for c in columns[:of]:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])]
        for a, b in zip(cuts, cuts[1:]):
            if held and any(held[0][i][0] != columns[i][a] for i in range(of)):
                yield [np.concatenate(parts) for parts in zip(*held)]
                held = []
            held.append([c[a:b] for c in columns])
    if held:
        yield [np.concatenate(parts) for parts in zip(*held)]


def with_partners(sets: DataFrame) -> DataFrame:
    """(key, at): a text of each set of which enough leading hashes stand in another set."""
    postings = sets.select(F.explode("hashes").alias("h"), "sid")

    def run(batches):
        last = None  # the last row so far: its hash, set and whether the row before had that hash
        for batch in batches:
            if not batch.num_rows:
                continue
            h, sid = (np.asarray(c) for c in batch.columns)
            before = False
            if last is not None:
                h, sid, before = np.concatenate(([last[0]], h)), np.concatenate(([last[1]], sid)), last[2]
            same = h[1:] == h[:-1]
            shared = np.concatenate(([before], same)) | np.concatenate((same, [False]))
            last = (h[-1], sid[-1], bool(same[-1]) if len(same) else before)
            yield pa.RecordBatch.from_arrays([pa.array(sid[:-1][shared[:-1]])], names=["sid"])
        if last is not None and last[2]:
            yield pa.RecordBatch.from_arrays([pa.array([last[1]], pa.int64())], names=["sid"])

    shared = postings.repartition("h").sortWithinPartitions("h").mapInArrow(run, "sid long").groupBy("sid").agg(F.count("*").alias("shared"))
    # l of the least partner's size, ceil(4n/5)
    needed = F.expr("(((4 * n + 4) div 5) + 9) div 10")
    return written(sets.select("sid", "n", "key", "at").join(shared, "sid").where(F.col("shared") >= needed).select("key", "at"), "partners")


def minimum_hashes(sets: DataFrame) -> DataFrame:
    """(sid, n, keys): the least product of a hash and each factor."""

    def run(batches):
        for batch in slices(batches, 2):
            rows = [[int((x.view(np.uint64) * np.uint64(f)).min().view(np.int64)) for f in KEYS] for x in _arrays(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.int64()))], names=["sid", "n", "keys"])

    return sets.select("sid", F.col("n").cast("long").alias("n"), "hashes").mapInArrow(run, "sid long, n long, keys array<long>")


def pair_blocks(blocks: Column, sid: Column) -> Column:
    """The pairs of blocks that a row goes to, so that each two rows of its group meet in one or more."""
    own = F.pmod(F.xxhash64(sid), blocks)
    others = F.filter(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda j: j != own)
    return F.when(blocks <= 1, F.array(F.lit(0).cast("long"))).otherwise(F.transform(others, lambda j: F.least(own, j) * blocks + F.greatest(own, j)))


def spanning(arrays: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of similar ones among arrays of distinct hashes that connect all that are connected.

    With C the hashes that most arrays have, two arrays differ by what each one
    differs from C less what they share of that.  Differences are few among near
    copies, so lists of who differs where take the place of whole comparisons.
    """
    m = len(arrays)
    if m == 2:
        return [(0, 1)] if similar(*arrays) else []
    n = np.array([len(a) for a in arrays])
    owner = np.repeat(np.arange(m), n)
    known, code, often = np.unique(np.concatenate(arrays), return_inverse=True, return_counts=True)
    usual = 2 * often > m
    alone = np.bincount(owner[often[code] == 1], minlength=m)
    has = np.zeros((m, int(usual.sum())), dtype=bool)
    has[owner[usual[code]], (np.cumsum(usual) - 1)[code[usual[code]]]] = True
    lacks_of, lacks = np.nonzero(~has)
    extra = ~usual[code] & (often[code] > 1)
    of = np.concatenate((lacks_of, owner[extra]))
    what = np.concatenate((np.flatnonzero(usual)[lacks], code[extra]))
    differs = np.bincount(of, minlength=m) + alone
    # Similar: n + n' >= 9 * (hashes that only one of them has).  Arrays that share no difference are so if both are near C.
    over = 9 * differs - n
    centre = int(over.argmin())
    near = over + over[centre] <= 0
    near[centre] = True
    root = np.where(near, centre, np.arange(m))
    links = [(int(x), centre) for x in np.flatnonzero(near) if x != centre]
    # Of the others, those with too many hashes of their own have no partner of any size.
    open_ = ~near & (45 * (n - alone) >= 4 * (5 * n + np.maximum(5 * n.min(), 4 * n)))
    by_what, by_who = np.argsort(what, kind="stable"), np.argsort(of, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(what, minlength=len(known)))))
    whose, rows = of[by_what], np.concatenate(([0], np.cumsum(np.bincount(of, minlength=m))))
    for x in np.flatnonzero(open_).tolist():
        mine = what[by_who[rows[x] : rows[x + 1]]]
        if not len(mine):
            continue
        others, shared = np.unique(np.concatenate([whose[ends[c] : ends[c + 1]] for c in mine]), return_counts=True)
        good = others[(n[x] + n[others] >= 9 * (differs[x] + differs[others] - 2 * shared)) & (root[others] != root[x])]
        roots, first = np.unique(root[good], return_index=True)
        for r, y in zip(roots.tolist(), good[first].tolist()):
            links.append((x, y))
            root[root == r] = root[x]
    return links


def contracted(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b) links that connect all similar sets that meet on a minimum hash."""
    met = keys.select("sid", "n", F.posexplode("keys").alias("which", "least"))
    sizes = met.groupBy("which", "least").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles")).where("sets > 1")
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("sets") / BLOCK_SETS))
    groups = met.join(written(sizes.select("which", "least", blocks.alias("blocks")), "met-sizes"), ["which", "least"])
    of_set = groups.groupBy("sid").agg(F.collect_list(F.struct("which", "least", "blocks")).alias("groups"))  # six at most
    dealt = sets.select("sid", "hashes").join(of_set, "sid").select("sid", "hashes", F.explode("groups").alias("g"))
    dealt = dealt.select("g.which", "g.least", F.explode(pair_blocks(F.col("g.blocks"), F.col("sid"))).alias("pair"), "sid", "hashes")

    def run(batches):
        at, sids, held = None, [], []
        for batch in batches:
            links = []
            columns = (batch.column(i).to_pylist() for i in range(4))
            for which, least, pair, sid, hashes in zip(*columns, _arrays(batch.column(4))):
                if (which, least, pair) != at:
                    links += [(sids[i], sids[j]) for i, j in spanning(held)] if len(held) > 1 else []
                    at, sids, held = (which, least, pair), [], []
                sids.append(sid)
                held.append(hashes.copy())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
        if len(held) > 1:
            links = [(sids[i], sids[j]) for i, j in spanning(held)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    order = ("which", "least", "pair")
    return written(dealt.repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long"), "contracted")


def open_pairs(sets: DataFrame, clusters: DataFrame, keys: DataFrame) -> DataFrame:
    """(a, b) pairs of sets in different clusters that share a leading shingle, rare ones first, and no minimum hash."""
    held = sets.select(F.explode("hashes").alias("h"), "sid", "n")
    often = written(held.groupBy("h").agg(F.count("*").alias("sets")).where("sets > 1"), "shared-shingles")
    w = Window.partitionBy("sid")
    ranked = held.join(often, "h").withColumn("single", F.col("n") - F.count("*").over(w)).withColumn("place", F.row_number().over(w.orderBy("sets", "h")))
    left = F.col("n") - F.col("single") - F.col("place") + 1  # from this shingle on
    leading = ranked.where("single + place <= n - ((4 * n + 4) div 5) + 1").select("h", "sid", "n", left.alias("left"))
    of_key = [F.col("keys")[i].alias(f"k{i}") for i in range(len(KEYS))]
    leading = leading.join(keys.select("sid", *of_key), "sid").join(clusters, "sid", "left")
    columns = ["n", "sid", F.coalesce("cluster", "sid").alias("cluster"), "left", *(f"k{i}" for i in range(len(KEYS)))]
    band = F.floor(F.log("n") / float(np.log(BAND)))
    leading = written(leading.select("h", F.explode(F.array(band, band + 1)).alias("band"), *columns), "leading")
    runs = leading.groupBy("h", "band").agg(F.count("*").alias("sets"), F.min("cluster").alias("c1"), F.max("cluster").alias("c2")).where("sets > 1 and c1 <> c2")
    runs = written(runs.select("h", "band", F.ceil(F.col("sets") / BLOCK_SETS).alias("blocks")), "runs")
    dealt = leading.join(runs, ["h", "band"])
    dealt = dealt.select("h", "band", F.explode(pair_blocks(F.col("blocks"), F.col("sid"))).alias("pair"), *leading.columns[2:])

    def run(batches):
        for _, _, _, n, sid, cluster, left, *of_keys in _runs(batches, 3):
            if (cluster == cluster[0]).all():
                continue
            ends = np.searchsorted(n, 5 * n // 4, side="right")
            for i in range(len(n) - 1):
                after = slice(i + 1, ends[i])
                # Similar sets share 4/9 of both sizes or more, all of it from their first shared shingle on.
                may = (cluster[after] != cluster[i]) & (9 * np.minimum(left[after], left[i]) >= 4 * (n[after] + n[i]))
                for k in of_keys:
                    may &= k[after] != k[i]
                others = sid[after][may]
                if len(others):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(others, sid[i])), pa.array(np.maximum(others, sid[i]))], names=["a", "b"])

    order = ("h", "band", "pair")
    return dealt.repartition(*order).sortWithinPartitions(*order, "n").mapInArrow(run, "a long, b long").distinct()


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar."""

    def run(batches):
        for batch in slices(batches, 2):
            good = [similar(x, y) for x, y in zip(_arrays(batch.column(2)), _arrays(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    one = sets.select(F.col("sid").alias("a"), F.col("hashes").alias("x"))
    two = sets.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def set_links(df: DataFrame, rows: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b) links of fingerprints whose texts have similar sets; ``rows`` are the text_sets of ``df``."""
    same = rows.where("n > 0").select("n", "d1", "d2", "fp").distinct()
    least = same.groupBy("n", "d1", "d2").agg(F.min("fp").alias("least"), F.count("*").alias("several")).where("several > 1")
    of_copies = same.join(least.drop("several"), ["n", "d1", "d2"]).select(F.col("fp").alias("a"), F.col("least").alias("b"))
    leading = distinct_sets(rows)
    partners = with_partners(leading)
    released(leading)
    # One text of each set: by its hash and the row's id, which may be null.
    texts = df.select(F.col(rows.columns[0]).alias("id"), F.col(text_col).alias("text"))
    again = texts.join(small(partners), F.col("id").eqNullSafe(F.col("at")) & (F.xxhash64("text") == F.col("key")), "left_semi")
    sets = distinct_sets(text_sets(again, True, "id", "text"))
    keys = written(minimum_hashes(sets), "set-keys")
    first = contracted(sets, keys)
    clusters = written(components(first).select(F.col("node").alias("sid"), F.col("root").alias("cluster")), "clusters")
    pairs = written(open_pairs(sets, clusters, keys), "open-pairs")
    links = first.unionByName(checked(pairs, sets))
    fps = sets.select("sid", "fp")
    named = links.join(fps.toDF("a", "fa"), "a").join(fps.toDF("b", "fb"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    out = written(of_copies.unionByName(named).where("a <> b"), "set-links")
    released(sets, keys, first, clusters, pairs)
    return out


def near_duplicates(df: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``simhash.near_duplicates``, with texts of similar sets linked too."""
    rows = written(text_sets(df, False, id_col, text_col), "text-sets")
    docs = rows.select(id_col, "fp")
    distinct = written(docs.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct")
    return grouped(docs, distinct, shard_links(distinct, radius).unionByName(set_links(df, rows, text_col)), id_col)
