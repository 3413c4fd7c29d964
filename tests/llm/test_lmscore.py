"""Elias-Fano sequences, and language-model scores against plain counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from civicframe.llm import eliasfano, lmscore


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 5000), max_size=80), st.integers(5001, 1 << 40), st.lists(st.integers(0, 6000), max_size=40))
def test_elias_fano(values, universe, asked):
    v = np.array(sorted(values), np.int64)
    for u in (5001, universe):
        e = eliasfano.EliasFano(b"\x00" * 8 + eliasfano.EliasFano.pack(v, u), 8)
        assert e.get(np.arange(len(v))).tolist() == v.tolist()
        x = np.array([a for a in asked if a < u], np.int64)
        assert e.successor(x).tolist() == np.searchsorted(v, x).tolist()
        assert e.find(x).tolist() == [v.tolist().index(a) if a in values else -1 for a in x.tolist()]
    repeated = np.sort(np.array(asked, np.int64))
    e = eliasfano.EliasFano(eliasfano.EliasFano.pack(repeated, 6001))
    assert e.get(np.arange(len(repeated))).tolist() == repeated.tolist()


def test_elias_fano_is_compact():
    v = np.unique(np.random.default_rng(0).integers(0, 1 << 40, 100_000))
    assert len(eliasfano.EliasFano.pack(v, 1 << 40)) * 8 < len(v) * (math.log2((1 << 40) / len(v)) + 3)


def expected(rows):
    texts = []
    for i, t in rows:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        texts.append((i, zlib.crc32((str(i) if i is not None else "").encode()) % 5 == 1, ["<s>", *re.findall("[^\x20\x09-\x0d]+", t), None]))
    c1, c2 = Counter(), Counter()
    for _, held, w in texts:
        if not held:
            c1.update(w)
            c2.update(zip(w, w[1:]))
    n, v = sum(c1.values()) - c1["<s>"], len(c1) - ("<s>" in c1)

    def rounded(p):
        return 10 ** (-min(round(-math.log10(p) * 20), 254) / 20) if p > 0 else 0.0
    out = []
    for i, held, w in texts:
        base = total = 0.0
        for k in range(1, len(w)):
            known = c1[w[k]]
            p1 = (known + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p1)
            u = w[k - 1]
            p = rounded(c2[u, w[k]] / (c1[u] + lmscore.MU)) + lmscore.MU / (c1[u] + lmscore.MU) * p1
            total += math.log10(p)
        out.append((i, held, len(w) - 1, sum(c1[x] > 0 for x in w[1:]), n, base, total))
    return out


def texts():
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)] + ["The", "THE", "é", "日本", "a\x0bb", "x y"]
    p = np.array([1 / (k + 1) for k in range(len(words))])
    rows = [(i, " ".join(r.choice(words, int(r.integers(0, 50)), p=p / p.sum()))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "only\x1cone"), (None, "the null id"), (None, None), (7, rows[7][1]), (7, rows[8][1]),
             (600, "hot " * 4000), (601, "hot hot never seen"), (602, "hot unseen1 unseen2")]
    rows += [(1000 + i, f"hot q{i} tail") for i in range(40)]
    return rows


@pytest.mark.parametrize("block,shard,share", [(1 << 21, 1 << 21, 1 / (1 << 16)), (300, 500, 1 / 30), (64, 200, 1.0), (2000, 90, 1 / 200)])
def test_scores(spark, monkeypatch, block, shard, share):
    monkeypatch.setattr(lmscore, "BLOCK", block)
    monkeypatch.setattr(lmscore, "SHARE", share)
    rows = texts()
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, score int, blk string").repartition(3)
    got = lmscore.score(df, shard)
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    order = lambda x: (x[0] is None, x[0] or 0, x[2], x[5])
    got, want = sorted(map(tuple, got.collect()), key=order), sorted(expected(rows), key=order)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=1e-9, atol=1e-9)


def test_nothing_and_no_training(spark):
    assert lmscore.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    rows = [(held, "no one learns"), (held, None)]
    got = sorted(map(tuple, lmscore.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=lambda x: x[2])
    assert np.allclose([x[2:] for x in got], sorted([x[2:] for x in expected(rows)]))


def test_model_beats_single_words_on_held_out_texts(spark):
    r = np.random.default_rng(1)
    follow = {f"s{i}": [f"s{j}" for j in r.integers(0, 200, 4)] for i in range(200)}
    rows = []
    for i in range(300):
        w = ["s0"]
        for _ in range(60):
            w.append(str(r.choice(follow[w[-1]])))
        rows.append((i, " ".join(w)))
    got = lmscore.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").toPandas()
    assert len(got) > 30 and got.score.sum() > 0.6 * got.base_score.sum()
