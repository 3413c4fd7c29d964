"""Token alignment against plain whole-text encoding by both libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from civicframe.llm import tokenalign
from civicframe.llm.tokencount import byte_alphabet

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def expected(rows):
    ta = Tokenizer.from_file(A)
    ta.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    alpha, names = byte_alphabet(), {i: t for t, i in ta.get_vocab().items()}

    def byte_b(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
    docs = []
    for _, t in rows:
        raw = (" " + (t or "")).encode()
        a = ta.encode(" " + (t or ""), add_special_tokens=False).ids
        b = sp.encode(t or "")
        xa = [bytes(alpha[c] for c in names[i]) if names[i] != "<|endoftext|>" else b"<|endoftext|>" for i in a]
        xb = [byte_b(i) for i in b]
        if not t or b"".join(xa) != raw or b"".join(xb) != raw:
            docs.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
        cuts = sorted(set(ea) & set(eb))
        groups, links, i, j = [], [], 0, 0
        for c in cuts:
            ga, gb = [], []
            while i < len(a) and ea[i] <= c:
                ga.append(i)
                i += 1
            while j < len(b) and eb[j] <= c:
                gb.append(j)
                j += 1
            groups.append(",".join(str(a[x]) for x in ga) + "|" + ",".join(str(b[x]) for x in gb))
            links += [(a[x], b[y]) for x in ga for y in gb
                      if max(ea[x] - len(xa[x]), eb[y] - len(xb[y])) < min(ea[x], eb[y])]
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    n = Counter(p for d in docs if d for p in set(d[3]))
    top = defaultdict(int)
    for (a, _), k in n.items():
        top[a] = max(top[a], k)
    out = []
    for (i, _), d in zip(rows, docs):
        out.append((i, 0, 0, 0, 0, 0, 0, "") if d is None else
                   (i, d[0], d[1], d[2], len(d[3]), sum(n[p] == top[p[0]] for p in d[3]), sum(n[p] for p in d[3]), d[4]))
    return out, n, top


@pytest.mark.parametrize("hot", [tokenalign.HOT_PAIRS, 40, 0])
def test_alignment(spark, hot):
    r = np.random.default_rng(5)
    words = ["tokens", "alignment", "Tokenizer", "aaaaaaa", "naïve", "日本語", "x1y2", "foo\nbar", "it's", "don't", "12345678", "ΑΒΓ", "🙂🙃", "zq"]
    rows = [(i, " ".join(r.choice(words, int(r.integers(1, 60))))) for i in range(30)]
    odd = [None, "", " ", "  two  spaces ", "a\n  b\t c \n", "under▁score", "▁", "a ▁ b", "<|endoftext|> x <|endoftext|>", "<unk> <s> <0x41>", "tab\there",
           "é  nbsp　wide", "\x00 \x01\x1c x", "\x85 next", "word " * 9000, "q" * 3000, "     ", "\n\n \n", "trailing ", "﻿bom", "�?"]
    rows += [(100 + i, t) for i, t in enumerate(odd)] + [(3, rows[3][1]), (None, rows[4][1]), (None, None)]
    df = spark.createDataFrame([(i, t, 7, "k") for i, t in rows], "doc_id long, text string, n_a int, key string").repartition(3)
    docs, pairs = tokenalign.alignment(df, A, B, hot_pairs=hot)
    assert docs.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want, n, top = expected(rows)
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(map(tuple, docs.collect()), key=key) == sorted(want, key=key)
    got = {(x["a"], x["b"]): (x["n"], x["best"]) for x in pairs.collect()}
    assert got == {p: (k, k == top[p[0]]) for p, k in n.items()}


def test_alignment_of_nothing(spark):
    docs, pairs = tokenalign.alignment(spark.createDataFrame([], "doc_id long, text string"), A, B)
    assert docs.count() == 0 and pairs.count() == 0


def test_units_give_the_tokens_of_whole_texts(spark):
    v = tokenalign.Vocabularies(A, B)
    assert v.cut
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        t = " " + r["text"]
        a, b = v.ids(tokenalign.BREAK.split(t))
        x, y = v.ids([t])
        assert sum(a, []) == x[0] and sum(b, []) == y[0]
