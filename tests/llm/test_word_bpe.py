import random

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import word_bpe

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = P.path("word_bpe_49k.json")


def odd_texts(n, seed):
    r = random.Random(seed)
    chars = "aabeEBs'Σσİ  \n\té'sßl19.,*\x00\x1c\x1f\x02\x85 　中Ⅷ٣𝄞́̀ÅKﬁ 한ㄱ"
    out = [None, "", " ", "\n \n", "a" * 3000, "ha" * 900, "ab" * 2000 + " " * 50 + "x", "<|endoftext|> it's", "<|ENDOFTEXT|>"]
    out += ["a<|endoftext|>b<|startoftext|><|endoftext|>", "<|startoftext|", "".join(r.choice("abcdefghij") for _ in range(5000))]
    return out + ["".join(r.choice(chars) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_ids_and_decoding_equal_the_library(spark):
    library = tokenizers.Tokenizer.from_file(PATH)
    rows = list(enumerate(odd_texts(3000, 7)))
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows + rows[:20]], "doc_id long, text string, ids int, Decoded string")
    got = word_bpe.decode(word_bpe.encode(df, PATH), PATH).collect()
    assert len(got) == len(rows) + 20
    for r in got:
        want = library.encode(rows[r.doc_id][1] or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_empty_tables_and_lists(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert word_bpe.decode(word_bpe.encode(none, PATH), PATH).collect() == []
    df = spark.createDataFrame([("a", None, 1), ("b", [], 2), ("c", [320, 49407], 3), ("d", None, 4)], "doc_id string, ids array<int>, decoded int").coalesce(1)
    got = word_bpe.decode(df, PATH).collect()
    assert [(r.doc_id, r.decoded) for r in got] == [("a", ""), ("b", ""), ("c", "a</w> <|endoftext|>"), ("d", "")]
    with pytest.raises(Exception, match="outside the vocabulary"):
        word_bpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), PATH).collect()


def test_other_kinds_of_files_are_refused(tmp_path):
    with pytest.raises(ValueError):
        word_bpe.WordBpe(P.path("byte_bpe_50k.json"))


def rescan(merges, symbols):
    rank = {(a, b): (i, c) for i, (a, b, c) in enumerate(merges)}
    symbols = list(symbols)
    while found := [(rank[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in rank]:
        _, i = min(found)
        symbols[i : i + 2] = [rank[symbols[i], symbols[i + 1]][1]]
    return symbols


def test_short_and_long_arrays_equal_a_rescan():
    r = random.Random(11)
    for _ in range(40):
        merges, known = [], [0, 1, 2]
        for c in range(3, r.randint(3, 14)):
            pair = (r.choice(known), r.choice(known))
            if pair not in [m[:2] for m in merges]:
                merges.append((*pair, c))
                known.append(c)
        array = word_bpe.RankArray(merges)
        assert array.rising
        for n in (0, 1, 2, 5, 30, 60):
            symbols = [r.randint(0, 2) for _ in range(n)] if n % 2 else [0] * n
            want = rescan(merges, symbols)
            assert array.merged(list(symbols)) == want
            if n > 1:
                assert array._merged_long(list(symbols)) == want


def test_merges_that_do_not_rise_are_scanned_one_by_one():
    merges = [(3, 0, 4), (0, 1, 3)]  # the first joins what the second makes
    array = word_bpe.RankArray(merges)
    assert not array.rising
    symbols = [0, 1, 0] * (word_bpe.LONG // 2)
    assert array.merged(list(symbols)) == rescan(merges, symbols)


def test_texts_are_coded_alike_in_any_batch():
    codec = word_bpe.codec(PATH)
    texts = odd_texts(200, 3)
    alone = [codec.encode(pa.array([t], pa.string())).to_pylist()[0] for t in texts]
    assert codec.encode(pa.array(texts, pa.string())).to_pylist() == alone
    assert codec.encode(pa.array(texts, pa.string()).slice(5, 50)).to_pylist() == alone[5:55]
    assert np.asarray(codec.encode(pa.array([], pa.string())).offsets).tolist() == [0]
