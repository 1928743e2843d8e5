import base64
import random
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyloom.llm import byte_bpe, packing, word_codes

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")


def odd_texts(n, seed):
    r = random.Random(seed)
    chars = "aab  \n\té'sßl19.,*\x1c\x1f\x85 　中Ⅷ٣𝄞́"
    out = [None, "", " ", "  ", "\n \n", "a" * 3000, "ab" * 2000 + " " * 50 + "x", "<|endoftext|> it's"]
    return out + ["".join(r.choice(chars) for _ in range(r.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library_and_decode_back(spark, library):
    rows = list(enumerate(odd_texts(2500, 1)))
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, ids int")
    ranks = P.path("byte_bpe_50k.tiktoken")
    got = byte_bpe.decode(byte_bpe.encode(df, ranks, P.PATTERN), ranks, P.PATTERN).collect()
    assert len(got) == len(rows)
    for r in got:
        text = rows[r.doc_id][1] or ""
        assert r.ids == library.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()


def test_null_and_empty_id_lists_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [64, 65]), (4, None)], "doc_id long, ids array<int>").coalesce(1)
    got = byte_bpe.decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    assert [(r.doc_id, bytes(r.decoded)) for r in got] == [(1, b""), (2, b""), (3, b"ab"), (4, b"")]


def test_queue_follows_ranks_not_places():
    ranks = {bytes([b]): i for i, b in enumerate(b"abc")} | {b"bc": 3, b"abc": 4, b"ab": 5, b"aa": 6, b"aaaa": 7}
    queue = byte_bpe.RankQueue(ranks)
    got = [np.frombuffer(x, "<i4").tolist() for x in queue.encode([b"abc", b"aaaaa", b"abab", b"", b"a"])]
    assert got == [[4], [7, 0], [5, 5], [], [0]]
    with pytest.raises(ValueError):
        queue.encode([b"ax"])


def rescan(ranks, piece):
    """The least rank, leftmost first, by looking at all pairs again after every merge."""
    parts = [bytes([b]) for b in piece]
    if piece in ranks:
        return [ranks[piece]]
    while pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        _, i = min(pairs)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


def test_queue_equals_the_rescan_for_any_order_of_ranks():
    r = random.Random(3)
    for _ in range(60):
        longer = {bytes(r.choice(b"ab") for _ in range(r.randint(2, 5))) for _ in range(r.randint(0, 25))}
        tokens = [b"a", b"b", *sorted(longer)]
        r.shuffle(tokens)
        ranks = {t: i for i, t in enumerate(tokens)}
        pieces = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 14))) for _ in range(60)]
        got = [np.frombuffer(x, "<i4").tolist() for x in byte_bpe.RankQueue(ranks).encode(pieces)]
        assert got == [rescan(ranks, p) for p in pieces]


def test_words_are_coded_alike_beside_any_others():
    import pyarrow as pa
    import regex

    pattern = regex.compile(P.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
    codes = word_codes.WordCodes(pattern, lambda ps: [np.array([*map(ord, p), 0], "<u4").tobytes() for p in ps])
    texts = [*odd_texts(600, 5), "a b  c d   e\n f", " x", "x ", "a \nb c", "it's a's  's"]
    for part in (texts, texts[::2], texts[:1], texts[5:6], []):
        ids, starts = codes.encode(pa.array(part, pa.string()))
        assert len(starts) == len(part) + 1
        for t, a, b in zip(part, starts, starts[1:]):
            assert ids[a:b].tolist() == [x for p in pattern.findall(t or "") for x in [*map(ord, p), 0]]


def test_copies_of_one_text_spread_over_tasks(spark):
    df = spark.range(20000, numPartitions=8).selectExpr("7 as doc_id", "'the same text again' as text")
    got = packing.pack(df, P.path("byte_bpe_50k.json"), window=64)
    tasks = [r["count"] for r in got.groupBy(F.shiftright("sequence_id", 36)).count().collect()]
    assert sum(tasks) == 20000 and max(tasks) <= 2500
    assert packing.pack(df, P.path("byte_bpe_50k.json"), window=64, docs_per_shard=100).groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 64").count() == 0


def test_decode_replaces_a_column_of_its_name(spark):
    df = spark.createDataFrame([(1, [64], b"old", "x")], "doc_id long, ids array<int>, Decoded binary, n_tokens string")
    got = byte_bpe.decode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert got.columns == ["doc_id", "ids", "n_tokens", "decoded"]
    assert [tuple(r) for r in got.collect()] == [(1, [64], "x", b"a")]


def test_best_fit_takes_the_tightest_window():
    placed = packing.best_fit_decreasing([600, 500, 424, 400, 120, 24, 10], 1024)
    windows = {}
    for n, (sequence, offset) in zip([600, 500, 424, 400, 120, 24, 10], placed):
        windows.setdefault(sequence, []).append((offset, n))
    assert placed[2][0] == placed[0][0] and placed[3][0] == placed[1][0]
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024
    r = random.Random(0)
    for _ in range(30):
        lengths = [r.randint(1, 63) for _ in range(r.randint(0, 200))]
        free, want = [], 0
        for n in sorted(lengths, reverse=True):
            fits = [f for f in free if f >= n]
            if fits:
                free.remove(min(fits))
                free.append(min(fits) - n)
            else:
                want += 1
                free.append(64 - n)
        assert len({s for s, _ in packing.best_fit_decreasing(lengths, 64)}) == want


def test_pieces_hold_every_id_once(spark):
    rows = list(enumerate(odd_texts(400, 2))) + [(9000, "word " * 9000), (9001, "tail"), (9001, "tail"), (None, "no id")]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, length int")
    got = packing.pack(df, P.path("byte_bpe_50k.json"), window=256, docs_per_shard=100).collect()
    coder = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    want = sorted((-1 if i is None else i, coder.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    docs, windows = {}, {}
    for x in got:
        ids = np.frombuffer(bytes(x.ids), "<u4").tolist()
        assert len(ids) == x.length and 0 < x.length <= 256
        docs.setdefault((-1 if x.doc_id is None else x.doc_id, x.doc_tokens), []).append((x.start, ids))
        windows.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    for i, ids in want:
        if i == 9001:
            assert sorted(docs[i, len(ids)]) == [(0, ids)] * 2
        else:
            joined = [x for _, part in sorted(docs[i, len(ids)]) for x in part]
            assert joined == ids and zlib.crc32(np.array(ids, "<u4").tobytes()) == zlib.crc32(np.array(joined, "<u4").tobytes())
    used = sum(n for p in windows.values() for _, n in p)
    assert used / (256 * len(windows)) > 0.93
    assert packing.pack(df.limit(0), P.path("byte_bpe_50k.json")).count() == 0
