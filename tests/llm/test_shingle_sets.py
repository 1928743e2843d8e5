import random

import numpy as np

import corpus_pipeline as C
from tallyloom.llm import shingle_sets
from tallyloom.llm.simhash import near_duplicates


def shingles(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    notice = [r.choice(words) for _ in range(60)]
    texts = []
    for i in range(60):
        body = [r.choice(words) for _ in range(r.choice([5, 9, 40, 64, 120, 250]))]
        if i % 3 == 0:
            body += notice
        texts.append(body)
        for _ in range(r.randint(0, 4)):
            body = list(body)
            for _ in range(r.randint(1, max(1, len(body) // 40))):
                body[r.randrange(len(body))] = r.choice(words)
            if r.random() < 0.3:
                body = body[: len(body) - len(body) // 8]
            texts.append(body)
    # many copies of one text, each with its own change, and texts that a shared notice makes alike below the bound
    long = [r.choice(words) for _ in range(150)]
    texts += [[f"own{i}" if j == i else w for j, w in enumerate(long)] for i in range(150)]
    texts += [notice + [r.choice(words) for _ in range(25)] for _ in range(40)]
    out = [" ".join(t) for t in texts]
    r.shuffle(out)
    return [*out, None, "", "one two", "One  two", "a b c d e", out[0]]


def brute(texts, by_fingerprint):
    """Least number of each text's group: similar sets and given fingerprint groups."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            alike = sets[i] and 5 * both >= 4 * len(sets[i] | sets[j]) and both
            if alike or by_fingerprint[i] == by_fingerprint[j]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(len(texts))}


def test_groups_equal_brute_force(spark):
    texts = near_copies(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    by_fingerprint = {x.doc_id: x.component_id for x in near_duplicates(df).collect()}
    want = brute(texts, by_fingerprint)
    assert want != brute(list(map(str, range(len(texts)))), by_fingerprint)
    got = {x.doc_id: x.component_id for x in shingle_sets.near_duplicates(df).collect()}
    assert got == want
    assert shingle_sets.near_duplicates(df.limit(0)).count() == 0


def test_search_is_complete_without_contraction(spark, monkeypatch):
    monkeypatch.setattr(shingle_sets, "KEYS", ())
    texts = near_copies(4)[-160:]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts, {x.doc_id: x.component_id for x in near_duplicates(df).collect()})
    assert {x.doc_id: x.component_id for x in shingle_sets.near_duplicates(df).collect()} == want


def variants(n, seed, most=13):
    """Texts of 300 words that differ from one text, which isn't among them, in 1 to ``most`` words."""
    r = random.Random(seed)
    body, out = [f"w{r.randrange(5000)}" for _ in range(300)], []
    for _ in range(n):
        changed = list(body)
        for at in r.sample(range(300), r.randint(1, most)):
            changed[at] = f"x{r.randrange(10**9)}"
        out.append(" ".join(changed))
    return out


def connected(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_spanning_links_are_true_few_and_connect_all():
    r = random.Random(12)
    for _ in range(300):
        base, arrays = r.sample(range(60), r.randint(1, 40)), []
        for _ in range(r.randint(2, 40)):
            own = set(r.sample(base, max(1, len(base) - r.randint(0, 6)))) | set(r.sample(range(100), r.randint(0, 4)))
            arrays.append(np.array(sorted(own)))
        arrays = [np.array(a) for a in {tuple(a.tolist()) for a in arrays}]
        if len(arrays) < 2:
            continue
        links = shingle_sets.spanning(arrays)
        assert len(links) < len(arrays) and all(shingle_sets.similar(arrays[a], arrays[b]) for a, b in links)
        pairs = [(i, j) for i in range(len(arrays)) for j in range(i) if shingle_sets.similar(arrays[i], arrays[j])]
        assert connected(len(arrays), links) == connected(len(arrays), pairs)


def test_pairs_do_not_grow_with_the_square_of_a_group(spark, monkeypatch):
    made, kept = {}, shingle_sets.written

    def counted(df, label):
        out = kept(df, label)
        made[label] = out.count()
        return out

    monkeypatch.setattr(shingle_sets, "written", counted)
    for n in (200, 400):
        df = spark.createDataFrame(list(enumerate(variants(n, 1))), "doc_id long, text string")
        shingle_sets.near_duplicates(df)
        assert made["contracted"] <= 6 * n and made["open-pairs"] <= n // 10


def test_blocks_of_a_large_group_lose_nothing(spark, monkeypatch):
    texts = variants(150, 2) + near_copies(5)[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(texts, {x.doc_id: x.component_id for x in near_duplicates(df).collect()})
    monkeypatch.setattr(shingle_sets, "BLOCK_SETS", 40)
    assert {x.doc_id: x.component_id for x in shingle_sets.near_duplicates(df).collect()} == want
    monkeypatch.setattr(shingle_sets, "KEYS", shingle_sets.KEYS[:1])
    assert {x.doc_id: x.component_id for x in shingle_sets.near_duplicates(df).collect()} == want


def test_stage_drops_near_copies(spark, tmp_path):
    r = random.Random(9)
    body = [f"w{r.randrange(5000)}" for _ in range(100)]
    changed = [*body[:50], "other", *body[51:]]
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in [(4, body), (9, changed), (11, body[:50] + ["x"] * 50)]]
    df = spark.createDataFrame([*rows, (None, rows[1][1], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {x.component_id for x in near_duplicates(df.where("doc_id < 10")).collect()} == {4, 9}
    assert sorted(str(x.doc_id) for x in C.near_dedup(spark, df, str(tmp_path)).collect()) == ["11", "4", "None"]
