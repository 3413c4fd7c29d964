"""Texts are encoded in place only where the screen proves them single and
missing; counts are the library's whatever the screen says."""

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from civicframe.llm import common, tokencount

PATH = P.path("byte_bpe_50k.json")


def texts():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "é", "<|endoftext|>", "  ", "42", "don't", "\n"]
    own = [" ".join(rng.choice(words, rng.integers(1, 30))) + f" {i}" for i in range(300)]
    # a third of all rows are one text; others come twice; nulls and empties
    return own + ["the same text"] * 200 + own[:40] + [None, "", "", None, "x " * 20_000]


@pytest.mark.parametrize("bits,sent", [(1 << 27, 1 << 16), (1 << 20, 0), (64, 1)])
def test_counts(spark, monkeypatch, bits, sent):
    monkeypatch.setattr(tokencount, "SCREEN", bits)
    monkeypatch.setattr(tokencount, "SENT", sent)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    library = Tokenizer.from_file(PATH)
    want = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    cache = common.shared_path(spark, "cache")
    for part in (df.where("doc_id % 3 = 0"), df, df):
        got = tokencount.token_counts(part, PATH, cache, limit=20).collect()
        assert len(got) == part.count()
        assert all((r.n_bytes, r.n_tokens) == want[r.doc_id] and r.over_limit == (r.n_tokens > 20) for r in got)
    stored = spark.read.parquet(cache)
    # each distinct text once, the later runs added only what was missing
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in rows})


def test_screen(spark):
    import hashlib
    names = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(2000)]
    df = spark.createDataFrame([(n,) for n in names[:1000]], "digest string")
    bits = np.frombuffer(tokencount.screen(df), np.uint8)
    assert tokencount.passes(bits, names[:1000]).all()
    assert tokencount.passes(bits, names[1000:]).sum() < 10
    empty = np.frombuffer(tokencount.screen(df.limit(0)), np.uint8)
    assert not tokencount.passes(empty, names).any() and not len(tokencount.passes(empty, []))
