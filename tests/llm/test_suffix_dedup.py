import random

import numpy as np
import pytest

from tallyloom.llm.suffix_array import permuted_prefixes, sais, suffix_array
from tallyloom.llm.suffix_dedup import dedup, segments


def test_suffix_arrays_and_prefixes_equal_sorting():
    r = random.Random(5)
    for _ in range(800):
        k = r.choice([1, 2, 3, 5, 200])
        s = bytes(r.randint(1, k) for _ in range(r.randint(0, 40))) + b"\0"
        text = np.frombuffer(s, np.uint8)
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert suffix_array(text).tolist() == want
        assert sais(text.astype(np.int64), 256).tolist() == want
        common = permuted_prefixes(text, np.array(want), 20)
        for x, y in zip(want, want[1:]):
            n = 0
            while n < 20 and x + n < len(s) and y + n < len(s) and s[x + n] == s[y + n]:
                n += 1
            assert common[y] == n


def test_deep_recursion_on_repetitive_texts():
    a, b = b"a", b"ab"
    for _ in range(14):
        a, b = b, b + a
    r = random.Random(2)
    unit = bytes(r.randrange(1, 250) for _ in range(1500))
    for s in (b + b"\0", unit * 40 + b"\0", b"xy" * 3000 + b"\0"):
        order = suffix_array(np.frombuffer(s, np.uint8))
        assert sorted(order.tolist()) == list(range(len(s)))
        assert all(s[i:] < s[j:] for i, j in zip(order.tolist()[::7], order.tolist()[1::7]))


def test_equal_windows_elect_equal_grams():
    r = random.Random(1)
    passage = bytes(r.randrange(97, 103) for _ in range(400))
    texts = [bytes(r.randrange(97, 103) for _ in range(r.randint(0, 90))) + passage + bytes(r.randrange(97, 103) for _ in range(70)) for _ in range(4)]
    data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    number, place, n, gram = segments(data, bounds, 100)
    by_window = {}
    covered = set()
    for t, p, k, g in zip(number.tolist(), place.tolist(), n.tolist(), gram.tolist()):
        for w in range(p, p + k):
            assert w + 100 <= bounds[t + 1] and w not in covered
            covered.add(w)
            assert by_window.setdefault(data[w : w + 100].tobytes(), g) == g
    assert len(covered) == sum(max(0, len(t) - 99) for t in texts)


def brute(rows, width):
    lowest = -(1 << 63)
    seen = {}
    for d, t in rows:
        key, b = lowest if d is None else d, (t or "").encode()
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            seen[w] = min(seen.get(w, (key, p)), (key, p))
    out = []
    for d, t in rows:
        key, b = lowest if d is None else d, (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] != (key, p):
                gone[p : p + width] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(int)))
        out.append((-1 if d is None else d, len(b), bytes(x for x, g in zip(b, gone) if not g), list(map(tuple, edges.reshape(-1, 2).tolist()))))
    return sorted(out)


@pytest.mark.parametrize("shard_segments", [4096, 3])
def test_dedup_equals_brute_force(spark, shard_segments):
    r = random.Random(7)
    words = ["lo", "rem", "ip", "é", "ß", "中", "x\n"]

    def some(n):
        return "".join(r.choice(words) for _ in range(n))

    passages = [some(r.randint(5, 150)) for _ in range(12)]
    rows = []
    for i in range(120):
        t = "".join(r.choice(passages) if r.random() < 0.5 else some(r.randint(0, 60)) for _ in range(r.randint(0, 6)))
        if r.random() < 0.3 and rows and rows[-1][1]:
            s = list(r.choice(rows)[1] or "a")
            s[r.randrange(len(s))] = "Z"
            t = "".join(s)
        rows.append((i * 3 % 151, t))
    rows += [(None, passages[0] * 2), (7, None), (5, ""), (11, "a" * 700), (12, "a" * 500 + "b"), rows[3], rows[3], (rows[4][0], "other" + passages[1])]
    df = spark.createDataFrame([(*x, 1, "b") for x in rows], "doc_id long, text string, start int, row string").repartition(5)
    got = sorted((-1 if x.doc_id is None else x.doc_id, x.n_bytes, bytes(x.kept), [tuple(s) for s in x.spans]) for x in dedup(df, 100, shard_segments).collect())
    assert got == brute(rows, 100)


def test_empty_table(spark):
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
