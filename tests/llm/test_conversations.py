import hashlib
import itertools
import random
import re
import zlib

import pytest

from pixelplan.llm import conversations

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """By Dijkstra over (row, initials so far as a state), whole edit strings compared."""
    import heapq

    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, edits, k, state, said = heapq.heappop(queue)
        if (k, state) in seen:
            continue
        seen.add((k, state))
        if k == len(rows) and state in ("", "a"):
            return cost, edits, "\n".join(said)
        new = "assistant" if state == "u" else "user"
        heapq.heappush(queue, (cost + 2, edits + "I", k, new[0], (*said, f"{new}:")))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(queue, (cost + 3, edits + "D", k + 1, state, said))
            if marks[k] not in ("blank", "duplicate"):
                extra = int(marks[k] == "truncated")
                heapq.heappush(queue, (cost + 2 + extra, edits + "R", k + 1, new[0], (*said, f"{new}:{text}")))
                if role and state + role[0] in ("s", "u", "su", "ua", "au"):
                    heapq.heappush(queue, (cost + extra, edits + "K", k + 1, role[0], (*said, f"{role}:{text}")))
    raise AssertionError


def plain(rows):
    convs = {}
    for r in rows:
        convs.setdefault(r[0], []).append(r)
    out = {}
    for conv, own in convs.items():
        left = damaged(own)
        marks = faults(left)
        turns = [t for t, *_ in left if t is not None]
        cost, edits, said = cheapest(left, marks)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(left))
        gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
        out[conv] = (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, edits, hashlib.sha256(said.encode()).hexdigest())
    return out


def some(seed, convs, most):
    r = random.Random(seed)
    texts = ["Yes.", "no", "", " \n", "Why?", "é!", "a\nb. ", None, "x" * 5000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "agent", "User"]
    rows = []
    for conv in (None, *range(convs)):
        turns = r.choice([range, lambda n: r.choices([None, *range(n)], k=n), lambda n: r.sample(range(-n, 2 * n), n)])(r.randint(1, most))
        rows += [(conv, t, r.choice(roles[: r.choice([2, 5, 10])]), r.choice(texts) if r.random() < 0.5 else f"text {r.random()}.") for t in turns]
    r.shuffle(rows)
    return rows


def got(spark, rows, **settings):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = conversations.digest(table, **settings).collect()
    assert len({x.conv_id for x in found}) == len(found)
    return {x.conv_id: tuple(x[1:]) for x in found}


@pytest.mark.parametrize(("block", "fan"), [(1024, 1024), (4, 3), (1, 2)])
def test_equals_plain_search(spark, block, fan):
    rows = some(block, 60, 30)
    assert got(spark, rows, block=block, fan=fan) == plain(rows)


def test_one_long_conversation(spark):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant"]), f"{r.randint(0, 400)}{r.choice(['.', ''])}") for t in range(3000)]
    assert got(spark, rows, block=64, fan=8) == plain(rows)


def test_repeated_rows_and_conversations_without_any(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), *[(5, None, "user", "Hi.")] * 50, (6, None, None, None)]
    found = got(spark, rows)
    assert found == plain(rows) and found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_rows_and_other_columns(spark):
    assert got(spark, []) == {}
    rows = [("a", 1, "user", "Hi.", 1, "x"), ("a", 2, "assistant", "Ho.", 2, "y")]
    table = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, number int, conv string")
    (row,) = conversations.digest(table).collect()
    assert row.conv_id == "a" and (row.gaps, row.cost, row.audit) == plain([r[:4] for r in rows])["a"][:1] + plain([r[:4] for r in rows])["a"][5:7]
