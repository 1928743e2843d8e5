import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from tallyloom.llm import ctw
from tallyloom.llm.ctw_model import block_estimate, contexts_cut, edge_sums, edges_of, grams_of, log_probabilities, snapped, weighed


def kt(a, b):
    p, seen = 0.0, [0, 0]
    for bit, n in ((0, a), (1, b)):
        for _ in range(n):
            p += math.log((seen[bit] + 0.5) / (sum(seen) + 1))
            seen[bit] += 1
    return p


def test_block_estimate_equals_sequential_coding():
    for a, b in [(0, 0), (1, 0), (3, 5), (40, 2), (200, 90)]:
        assert abs(block_estimate(np.array([a]), np.array([b]))[0] - kt(a, b)) < 1e-8


def brute_log10(train, lines, depth):
    """Log10 probabilities of lines by a plain recursive tree over (context, position, bits)."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def steps(line):
        padded = b"\n" * depth + line
        for i in range(len(line)):
            context = padded[i : i + depth]
            for k in range(8):
                bits = line[i] >> (8 - k)
                yield context, k, bits, line[i] >> (7 - k) & 1

    for line in train:
        for context, k, bits, bit in steps(line):
            for d in range(depth + 1):
                node = (context[depth - d :], k, bits)
                counts[node][bit] += 1
                if d:
                    children[(context[depth - d + 1 :], k, bits)].add(node)
    weighted = {}

    def weigh(node, d):
        if node not in weighted:
            own = float(block_estimate(np.array([counts[node][0]]), np.array([counts[node][1]]))[0])
            if d == depth:
                weighted[node] = (own, 0.0)
            else:
                below = sum(weigh(c, d + 1)[0] for c in children[node])
                weighted[node] = (np.logaddexp(own, below) + math.log(0.5), own - below)
        return weighted[node]

    out = []
    for line in lines:
        total = 0.0
        for context, k, bits, bit in steps(line):
            p = 0.5  # what a context that was never met predicts
            for d in range(depth, -1, -1):
                node = (context[depth - d :], k, bits)
                if node in counts:
                    a = counts[node]
                    here = (a[bit] + 0.5) / (sum(a) + 1)
                    w = 1.0 if d == depth else 1 / (1 + math.exp(-max(-500, min(500, weigh(node, d)[1]))))
                    p = w * here + (1 - w) * p
            total += math.log10(p)
        out.append(total)
    return out


def _lines(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(["the", "then", "é", "ab", "abba", "x"]) for _ in range(r.randint(0, 12))).encode() + b"\n" for _ in range(n)]


def values_in_parts(grams, counts, depth, cuts):
    """log10 probabilities of sorted grams, part by part, with the edges' sums passed up level by level."""
    part = np.searchsorted(np.array(cuts, dtype=np.uint64), grams, side="right")
    ends = [edges_of(cuts[max(p - 1, 0) : p + 1], depth) for p in range(len(cuts) + 1)]
    sums = defaultdict(lambda: np.zeros(3))
    for p in set(part.tolist()):
        for d, node, *values in zip(*edge_sums(grams[part == p], counts[part == p], depth, ends[p])):
            sums[int(d), int(node)] += values
    known = {}
    for d in range(depth, -1, -1):
        nodes = np.array(sorted(n for at, n in sums if at == d), dtype=np.int64)
        zeros, ones, below = np.array([sums[d, int(n)] for n in nodes]).reshape(-1, 3).T
        stop, weighted = weighed(zeros, ones, below, d == depth)
        known[d] = (nodes, zeros, ones, stop)
        for n, w in zip(nodes.tolist(), weighted):
            if d:
                sums[d - 1, (n >> 19) << 11 | n & 0x7FF][2] += w
    out = np.zeros(len(grams))
    for p in set(part.tolist()):
        out[part == p] = log_probabilities(grams[part == p], counts[part == p], depth, ends[p], known)
    return out


def test_array_model_equals_recursive_tree_however_it_is_cut():
    depth = 3
    train, test = _lines(30, 1), _lines(10, 2) + [b"zq\n", b"\n", b"the zzz\n"]
    every = np.concatenate([grams_of(x, depth, 10) for x in train])
    grams = np.unique(np.concatenate([every, *(grams_of(x, depth, 10) for x in test)]))
    counts = np.zeros(len(grams))
    np.add.at(counts, np.searchsorted(grams, every), 1)
    want = brute_log10(train, test, depth)
    r = random.Random(7)
    middle = grams[len(grams) // 2] & ~np.uint64(0xFF)  # cuts inside one context's grams too
    for cuts in ([], [int(grams[9])], sorted(r.sample(grams.tolist(), 6)), [int(middle) + 1, int(middle) + 98, int(middle) + 110], snapped(sorted(r.sample(grams.tolist(), 8)))):
        values = values_in_parts(grams, counts, depth, cuts)
        got = [values[np.searchsorted(grams, grams_of(x, depth, 10))].sum() for x in test]
        assert np.allclose(got, want, rtol=1e-6, atol=1e-6)


def test_cuts_move_to_short_contexts_and_stay_apart():
    r = random.Random(9)
    for _ in range(50):
        cuts = sorted(r.randrange(256**7) >> r.choice([0, 0, 20]) for _ in range(20))
        moved = snapped(cuts)
        assert moved == sorted(set(moved)) and len(moved) == len({c for c in cuts if c})
        assert all(a < m <= b for a, m, b in zip([0, *sorted(set(cuts))], moved, sorted(set(cuts)), strict=False)) or 0 in cuts
    assert snapped([(5 << 48) + 3, (7 << 48) + (1 << 40) + 9]) == [5 << 48, 7 << 48]
    assert contexts_cut(7 << 48, 6) == {0: 0} and contexts_cut((7 << 48) + (2 << 40), 6) == {0: 0, 1: 7}


def test_probabilities_of_all_bytes_sum_to_one():
    depth = 4
    train = _lines(40, 3)
    every = np.concatenate([grams_of(x, depth, 10) for x in train])
    for context in (b"the ", b"zzzz", b" abb"):
        base = sum(b << (8 * (depth - i)) for i, b in enumerate(reversed(context)))
        asked = np.array([base + c for c in range(256)], dtype=np.uint64)
        grams = np.unique(np.concatenate([every, asked]))
        counts = np.zeros(len(grams))
        np.add.at(counts, np.searchsorted(grams, every), 1)
        p = 10 ** values_in_parts(grams, counts, depth, [])[np.searchsorted(grams, asked)]
        assert abs(p.sum() - 1) < 1e-9


def test_scores_of_a_table(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(40)] + ["THE", "Ünder"]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(200)]
    rows += [(500, None), (501, ""), (None, "the w1"), rows[0], rows[0], (502, "w1\n\tw2  w3" * 500)]
    df = spark.createDataFrame([(*x, 5) for x in rows], "doc_id long, text string, n_tokens int").repartition(3)
    trains = F.col("doc_id") % 5 != 0
    got = ctw.scores(df, trains, depth=4).collect()
    assert len(got) == len(rows)
    cut = ctw.scores(df, trains, depth=4, grams_per_part=300, chunk_grams=64).collect()
    by_row = lambda x: (-1 if x.doc_id is None else x.doc_id, round(x.score, 3), x.n_bytes, x.n_known)
    assert sorted(map(by_row, cut)) == sorted(map(by_row, got))

    def tokens(t):
        return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["\n"]

    counts = Counter(w for i, t in rows if i is not None and i % 5 for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((-1 if i is None else i, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows)
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 6)) for x in got) == want
    assert all(x.train_tokens == n and x.train_types == v and x.score < 0 for x in got)
    lines = {i: " ".join(tokens(t)[:-1]).encode() + b"\n" for i, t in rows if i is not None}
    train = [" ".join(tokens(t)[:-1]).encode() + b"\n" for i, t in rows if i is not None and i % 5]
    some = [x for x in got if x.doc_id in (0, 1, 500, 501, 35)]
    assert np.allclose([x.score for x in some], brute_log10(train, [lines[x.doc_id] for x in some], 4), rtol=1e-4, atol=1e-4)
    held = [x for x in got if not x.trained and x.n_tokens > 5]
    assert sum(x.score for x in held) > sum(-2.5 * x.n_bytes for x in held)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert ctw.scores(df.limit(0), F.lit(True), depth=3).count() == 0
    (row,) = ctw.scores(df, F.lit(False), depth=3).collect()
    assert row.train_tokens == 0 and abs(row.score - 8 * 4 * math.log10(0.5)) < 1e-5 and row.base_score == 0
