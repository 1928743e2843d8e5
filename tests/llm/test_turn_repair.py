import hashlib
import heapq
import random
import re
import zlib

import pytest

from tallyloom.llm import turn_repair


def cheapest(rows):
    """Least cost and audit by a best-first search over whole audits; rows are (initial, must go, truncated)."""
    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, made = heapq.heappop(heap)
        key = (i, made if made in ("", "s") else made[-1])
        if key in done:
            continue
        done.add(key)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", made):
            return cost, audit, made
        for c in {"": "su"}.get(made) or ("u" if made[-1] in "sa" else "a"):
            if c != "s":
                heapq.heappush(heap, (cost + 2, audit + "I", i, made + c))
            if i < len(rows) and not rows[i][1]:
                if rows[i][0] == c:
                    heapq.heappush(heap, (cost + rows[i][2], audit + "K", i + 1, made + c))
                elif c != "s":
                    heapq.heappush(heap, (cost + 2 + rows[i][2], audit + "R", i + 1, made + c))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, made))


def test_lengths_and_states_give_the_least_audit():
    r = random.Random(5)
    for _ in range(3000):
        rows = [(r.choice(["u", "u", "a", "a", "s", " ", ""]), r.random() < 0.2, r.random() < 0.2) for _ in range(r.randint(0, 11))]
        coded = tuple((c, "x" if goes else "t" if cut else ".") for c, goes, cut in rows)
        want = cheapest(rows)[:2]
        assert turn_repair.by_lengths(coded) == want
        assert turn_repair.by_states(coded) == want


def test_long_conversations_agree_at_the_border():
    r = random.Random(6)
    for n in (1, 40, turn_repair.ALIGNED_ROWS, turn_repair.ALIGNED_ROWS + 1):
        coded = tuple((r.choice("uas"), r.choice("..xt")) for _ in range(n))
        assert turn_repair.by_lengths(coded) == turn_repair.by_states(coded)


def by_hand(rows):
    """The contract in plain Python, over (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            left += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        left.sort()
        faults, seen, marks = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, _, role, text in left:
            words = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                faults[fault] += 1
            marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, audit, made = cheapest(marks)
        turns, repaired, at, place = [t for known, t, _, _ in left if known], [], 0, 0
        for edit in audit:
            role, text = ("", "") if edit == "I" else left[at][2:]
            at += edit != "I"
            if edit != "D":
                repaired.append(f"{role if edit == 'K' else {'u': 'user', 'a': 'assistant'}[made[place]]}:{text}")
                place += 1
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        out[conv] = (gaps, *faults.values(), illegal, cost, audit, digest)
    return out


def test_rows_equal_the_contract_by_hand(spark):
    r = random.Random(8)
    rows = []
    for conv in [None, *range(250)]:
        for turn in range(r.randint(1, 7)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((conv, r.choice([turn, turn, turn * 2, None]), role, r.choice(["Yes.", "No", "  ", "", None, "a\nb?", "Ünter! \t"])))
    rows += rows[:40]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, "other") for x in rows], "conv_id long, turn long, role string, text string, copy string")
    got = turn_repair.repaired(turn_repair.damaged(df)).collect()
    want = by_hand(rows)
    assert len(got) == len(want)
    for g in got:
        assert (g.gaps, g.blank, g.duplicate, g.truncated, g.illegal, g.cost, g.audit, g.repaired_sha256) == want[g.conv_id]


def test_names_as_ids_empty_tables_and_texts_in_a_file(spark, monkeypatch):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert turn_repair.repaired(turn_repair.damaged(none)).collect() == []
    rows = [(f"c{i // 90}", i % 90, "user" if i % 2 else "assistant", f"{'x' * (i % 7)} {i}.") for i in range(360)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r for r in turn_repair.repaired(turn_repair.damaged(df)).collect()}
    want = by_hand(rows)
    for conv, r in got.items():
        assert (r.cost, r.audit, r.repaired_sha256) == want[conv][5:]
    held = turn_repair._Conversation(1)
    monkeypatch.setattr(turn_repair, "HELD_BYTES", 10)
    filed = turn_repair._Conversation(1)
    for c in (held, filed):
        for i in range(9):
            c.add(i, "user", "long enough to leave memory.", False, False)
            c.add(i, "assistant", f"{i}!", False, False)
    assert held.result() == filed.result()


@pytest.mark.parametrize("last,open_end", [("a.", False), ("a. \n", False), ("a", True), ("é ", True), ("", False), (" \x0b", False), ("a.\x1c", True), ("a ", True)])
def test_last_characters(spark, last, open_end):
    r = turn_repair.marked(spark.createDataFrame([(last,)], "text string")).first()
    assert (r.open_end, r.blank) == (open_end, not last.strip(" \t\n\x0b\f\r"))
