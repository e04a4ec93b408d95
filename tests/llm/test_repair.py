import hashlib
import heapq
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cairn.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = "\x20\t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """Best-first search over (rows read, roles written), by cost and then audit: no states, no matrices."""
    grammar = re.compile("(s?(ua)+)?")
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, said = heapq.heappop(heap)
        if i == len(rows) and grammar.fullmatch(roles):
            return cost, audit, [f"{r}:{t}" for r, t in said]
        if (i, roles[:1] == "s", roles[-1:], len(roles) > 0) in done:
            continue
        done.add((i, roles[:1] == "s", roles[-1:], len(roles) > 0))
        nexts = "su" if not roles else "a" if roles[-1] == "u" else "u"
        for role in nexts.replace("s", ""):
            heapq.heappush(heap, (cost + 2, audit + "I", i, roles + role, (*said, ({"u": "user", "a": "assistant"}[role], ""))))
        if i < len(rows):
            _, _, own, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, roles, said))
            if marks[i] not in ("blank", "duplicate"):
                extra = marks[i] == "truncated"
                if own[:1] and own[:1] in nexts:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, roles + own[:1], (*said, (own, text))))
                for role in nexts.replace("s", ""):
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, roles + role, (*said, ({"u": "user", "a": "assistant"}[role], text))))


def expected(rows):
    by = defaultdict(list)
    for r in damaged(rows):
        by[r[0]].append(r)
    out = []
    for conv in {r[0] for r in rows}:
        own = sorted(by[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        marks = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, said = cheapest(own, marks)
        out.append((conv, gaps, *(marks.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest()))
    return Counter(out)


def conversations(n, longest, seed=1):
    rng, out = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            text = rng.choice(["Yes.", "No!", "Well", "", "  ", f"Number {rng.randrange(50)}.", f"So {rng.randrange(50)}? "])
            out.append((conv, rng.choice([turn, turn, turn, 2 * turn, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), text))
    return out


def found(spark, rows, schema=SCHEMA):
    return Counter(map(tuple, repair.repair_damaged(spark.createDataFrame(rows, schema).repartition(3)).collect()))


def test_whole_table_equals_brute_force(spark):
    rows = conversations(250, 9)
    assert found(spark, rows) == expected(rows)


def test_blocks_and_trees_of_any_size(spark, monkeypatch):
    rows = conversations(12, 60, 2) + [(99, t, "user" if t % 3 else "assistant", f"t{t // 2 if t % 2 else t}.") for t in range(90)]
    monkeypatch.setattr(repair, "BLOCK", 3)
    monkeypatch.setattr(repair, "FAN", 2)
    assert found(spark, rows) == expected(rows)


def test_awkward_rows_and_extra_columns(spark):
    rows = [
        (None, None, None, None), (None, 1, "user", "Hello."), (None, 1, "user", "Hello."), (1, None, "system", "Be kind."), (1, 0, "user", "long " * 20_000 + "end"),
        (2, 5, "assistant", "é!"), (2, 9, "user", "ü?\n\t"), (3, 1, "", "."), (4, 2, "sue", "."), (4, 3, "abe", "x"), (4, 3, "abe", "x"), (4, None, "abe", None),
    ] + [(c, 0, "user", "Gone?") for c in range(10, 60)]
    assert found(spark, rows) == expected(rows)
    assert any(zlib.crc32(f"{c}:0".encode()) % 20 == 0 for c in range(10, 60))
    wide = [(*r, 3, "x", 1, 2) for r in rows]
    assert found(spark, wide, SCHEMA + ", n long, fault string, first long, at int") == expected(rows)


def test_one_conversation_of_a_third(spark):
    rows = [(i, t, ("user", "assistant")[t % 2], f"m{i}-{t}.") for i in range(200) for t in range(4)] + [(7, 10 + t, "user", "again and again.") for t in range(400)]
    assert found(spark, rows) == expected(rows)


@pytest.mark.parametrize("symbols", ["u" * 700, "x" * 300 + "A" * 257 + "s" * 3, "suUxaAoO" * 40])
def test_powers_equal_single_steps(symbols):
    import numpy as np

    one = np.asarray(repair.block_matrix(symbols)).reshape(4, 4)
    many = np.asarray(repair._product([repair.block_matrix(s) for s in symbols])).reshape(4, 4)
    assert (one == many).all()
    for state in range(4):
        tokens, after, cost = repair.unroll(symbols, list(repair.END), state)
        assert len(tokens) == len(symbols) and cost + repair.END[after] == (one + np.asarray(repair.END)).min(axis=1)[state]


def test_messages_follow_the_grammar(spark):
    fixed = repair.repair(spark.createDataFrame(conversations(60, 12, 3), SCHEMA))
    said = defaultdict(list)
    for r in fixed.messages.orderBy("first", "at", "k").collect():
        said[r.first].append(r.role[:1])
    assert said and all(re.fullmatch("s?(ua)+", "".join(x)) for x in said.values())


def test_empty_table(spark):
    assert found(spark, []) == Counter()
    assert repair.repair(spark.createDataFrame([], SCHEMA)).messages.select(F.count("*")).first()[0] == 0
