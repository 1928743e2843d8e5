import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tallyloom.llm import decision_list as D
from tallyloom.llm.text_stats import with_stats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    r = random.Random(2)
    words = ["a", "b", "çà", "中", "#x", "|", "Up", "\x1cq", " ", "long"]
    out = [None, "", " \n\t\r\x0b\x0c", "one", "a b c a b c", "x " * 5000, "a b c\n" * 40, "\n\n", "a b\na b \na b"]
    for _ in range(200):
        n = r.randint(0, 60)
        out.append("".join(r.choice(words[: r.randint(2, 10)]) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(n)))
    return out


def test_statistics_equal_brute_force(spark):
    rows = [(i, t, 7, "own") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, words int, __x string")
    got = with_stats(df).collect()
    assert len(got) == len(rows) and {"words", "__x"} <= set(df.columns)
    for row in got:
        want = brute(rows[row.doc_id][1])
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want, rows[row.doc_id]


def _labelled(n, seed=0):
    r = random.Random(seed)
    rows = []
    for _ in range(n):
        bad = r.random() < 0.3
        shouting = bad and r.random() < 0.5
        rows.append((dict(words=r.randint(60, 500), upper=r.uniform(0.5, 1) if shouting else r.uniform(0, 0.2), symbols=r.uniform(0.2, 0.6) if bad and not shouting else r.uniform(0, 0.1)), bad))
    return rows


def test_rules_separate_held_out_rows():
    rules = D.learn(_labelled(1500))
    held = _labelled(800, seed=9)
    said = [any(all(c.holds(x) for c in rule) for rule in rules) for x, _ in held]
    assert rules and sum(s == y for s, (_, y) in zip(said, held)) / len(held) > 0.98
    assert not any(s and not y for s, (_, y) in zip(said, held))


def test_no_labels_or_one_class_gives_no_rules():
    assert D.learn([]) == []
    assert D.learn([({"a": 1.0}, True)] * 20) == []
    assert D.learn([({"a": float(i % 2)}, i % 3 == 0) for i in range(60)]) == []


def test_quality_on_tables(spark):
    good = " ".join(f"w{i}" for i in range(80))
    bad = " ".join(f"W{i}!!" for i in range(80)).upper()
    rows = [(i, f"{good} g{i}" if i % 3 else f"{bad} B{i}") for i in range(240)] + [(None, None), (900, ""), (901, good), (901, good)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("quality", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(160)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out, rules = D.quality(docs, labels)
    got = {(r.doc_id, r.kept) for r in out.collect()}
    assert rules and out.count() == len(rows)
    assert all((i, bool(i % 3)) in got for i in range(240))
    assert (None, False) in got and (900, False) in got and (901, True) in got
    none, no_rules = D.quality(docs, labels.limit(0))
    assert no_rules == [] and none.where("kept").count() == 242
    assert D.quality(docs.limit(0), labels)[0].count() == 0


def test_ids_of_text_and_columns_of_the_results_names(spark):
    rows = [(f"d{i}", " ".join(f"w{i}x{k}" for k in range(60)) + " #$%&" * (40 if i % 3 == 0 else 0), 5, "k", True, 0.5, i) for i in range(120)]
    df = spark.createDataFrame([*rows, (None, None, 5, "k", True, 0.5, -1)], "doc_id string, text string, N_words int, kept string, base_failed boolean, __stats_text double, in_1 int")
    labels = spark.createDataFrame([(f"d{i}", int(i % 3 != 0)) for i in range(120)] + [(None, 1), ("d1", None)], "doc_id string, quality int")
    judged, rules = D.quality(df, labels)
    assert rules and len(set(map(str.lower, judged.columns))) == len(judged.columns)
    got = judged.collect()
    assert len(got) == 121 and all(r.n_words == (0 if r.text is None else len(r.text.split())) for r in got)
    assert all(r.kept == (r.in_1 % 3 != 0 and r.in_1 >= 0) and r["__stats_text"] == 0.5 for r in got)
