import random
import re

import xxhash

from tallyloom.llm.components import components
from tallyloom.llm.simhash import links_of_shard, near_duplicates, shard_masks


def brute_groups(values, radius):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def _values(seed=3):
    r = random.Random(seed)
    values = {r.getrandbits(64) for _ in range(40)} | {0}
    for _ in range(350):
        v = r.choice(sorted(values))
        for _ in range(r.randint(1, 3)):
            v ^= 1 << r.randrange(64)
        values.add(v)
    return sorted(values)


def test_tree_links_equal_all_pairs():
    values = _values()
    want = {v: g for v, g in brute_groups(values, 2).items() if v != g}
    assert dict(links_of_shard(values, 2)) == want


def test_shards_lose_no_link():
    values = _values(4)
    for a in values[:200]:
        for b in values[:200]:
            if a < b and (a ^ b).bit_count() <= 2:
                assert any(not (a ^ b) & (m % (1 << 64)) for m in shard_masks(2))
    assert max(64 - (m % (1 << 64)).bit_count() for m in shard_masks(2)) <= 16


def brute_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(8)
    words = [f"Wörd{i}" for i in range(50)]
    rows = []
    for i in range(60):
        base = [r.choice(words) for _ in range(r.randint(0, 400))]
        for k in range(r.randint(1, 4)):
            copy = list(base)
            if copy and k:
                copy[r.randrange(len(copy))] = "changed"
            rows.append((len(rows) * 7 % 1009, r.choice([" ", "\n", " \t"]).join(copy)))
    rows += [(5000, None), (5001, ""), (5002, "two words"), (None, "two words"), rows[0], rows[0]]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, fp string").repartition(3)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = [brute_fingerprint(t) for _, t in rows]
    groups = brute_groups(sorted(set(fps)), 2)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[groups[f]] = min(least.get(groups[f], i), i)
    want = sorted((-1 if i is None else i, f, least[groups[f]]) for (i, _), f in zip(rows, fps))
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.fp % (1 << 64), x.component_id) for x in got) == want
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (None, 3), (200, 100), (300, 301), (301, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {x: 100 for x in [*range(100, 160), 200]} | {300: 300, 301: 300}
    assert got == want
