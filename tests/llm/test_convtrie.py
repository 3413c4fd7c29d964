"""Conversation trie against a plain Python trie."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from civicframe.llm import convtrie

SCHEMA = "conv_id long, turn int, role string, text string"


def expected(rows):
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, path in made.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for path, m in members.items():
        below = [q for q in members if q[:len(path)] == path]
        end = sorted(c for c in m if len(made[c]) == len(path))
        out.append((min(m), len(path), min(members[path[:-1]]) if path else None, len(m),
                    sum(len(q) == len(path) + 1 for q in below),
                    sum(not any(z[:len(q)] == q and len(z) == len(q) + 1 for z in members) for q in below),
                    sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q),
                    hashlib.sha256(",".join(map(str, end)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations():
    r = np.random.default_rng(4)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 240), 12345678901]:
        first = int(r.integers(0, 3))
        for t in range(int(r.integers(1, 9))):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", f"é{first}" if t == 0 else f"w{r.integers(0, 2 + t // 3)}🙂"))
    rows += [(300, t, "u", f"long {t % 7}") for t in range(400)] + [(301, t, "u", f"long {t % 7}") for t in range(380)]
    rows += [(400, None, None, None), (400, None, "a", "b"), (400, 1, "", "tie"), (400, 1, "", "also"), (None, 0, "u", "lost"), (401, 5, None, "x"),
             (0, 0, "user", "repeated"), (0, 0, "user", "repeated")]
    rows += [(500 + i, t, "u", f"same {t}") for i in range(90) for t in range(7)]
    return rows


@pytest.mark.parametrize("width", [None, 1, 64, 1 << 20])
def test_trie(spark, width):
    rows = conversations()
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], SCHEMA + ", depth int, key string").repartition(4)
    got = convtrie.conversation_trie(df, width)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_long_ends_and_small_tables(spark, monkeypatch):
    monkeypatch.setattr(convtrie, "RUN", 7)
    rows = [(1000 * i, 0, "u", "the same") for i in range(200)]
    got = sorted(map(tuple, convtrie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == expected(rows)
    one = [(7, 3, "u", "x")]
    assert sorted(map(tuple, convtrie.conversation_trie(spark.createDataFrame(one, SCHEMA)).collect()), key=str) == expected(one)
    assert convtrie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert convtrie.conversation_trie(spark.createDataFrame([(None, 0, "u", "x")], SCHEMA)).count() == 0


def test_screen_lets_no_shared_prefix_pass(spark):
    turns = convtrie.in_order(spark.createDataFrame(conversations(), SCHEMA))
    p = convtrie.prefixes(*convtrie.rebuilt(turns))
    n = {r["key"]: r["count"] for r in p.groupBy("key").count().collect()}
    tails = convtrie.screened(p).where("tail").collect()
    assert tails and all(n[r["key"]] == 1 for r in tails)
