"""Data beyond former caps, columns whose names clash, and the pipeline on a
table with every odd row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from civicframe.llm import charlstm, decontaminate, license_scan, mixing, pii, quality, secrets, simhash


@pytest.fixture(scope="module")
def model():
    lines = pii.generated()
    win = np.stack([pii.cut_windows(charlstm.classes(t), np.zeros(1, np.int64))[0] for t, _ in lines])
    tag = np.stack([np.concatenate([pii.tags_of(len(t), s), np.zeros(pii.WINDOW, np.int8)])[:pii.WINDOW] for t, s in lines])
    return charlstm.train(win, tag, len(pii.KINDS), pii.EPOCHS)


def test_names_of_any_length():
    value = "x9Q2mT7vL4kZpR81"
    for n in (100, 127, 128, 129, 500, 5000):
        t = f'{"n" * n} = "{value}"\nprivate_key = {"n" * n}'
        assert [(a, b) for a, _, b in secrets.spans(t.encode())[1]] == [(n + 4, n + 4 + len(value))], n
        assert secrets.name_before("1" * n + "ab" + " " * n, 2 * n + 2) == "ab"
        assert secrets.name_before("ab" + "1" * n + '"', n + 3) == "ab" + "1" * n
    assert secrets.name_before("", 0) is None and secrets.name_before(" " * 400, 400) is None and secrets.name_before("9" * 400, 400) is None


def test_every_license_notice_is_a_span():
    auto = license_scan.Automaton()
    mit = next(t for lab, t in license_scan.TEMPLATES if lab == "mit" and "MERCHANTABILITY" in t)
    bsd = next(t for lab, t in license_scan.TEMPLATES if lab == "bsd-3-clause")
    words = [w for t in (mit, "some other words stand here", mit, bsd, "code", mit) for w in license_scan.words_of(t.encode())]
    n = len(license_scan.words_of(mit.encode()))
    whole = [(s, e) for t, c, s, e in auto.scan(words)[1] if auto.labels[t] == "mit" and auto.sizes[t] == n and c == n]
    m = len(license_scan.words_of(bsd.encode()))
    assert whole == [(0, n), (n + 5, 2 * n + 5), (2 * n + 6 + m, 3 * n + 6 + m)]
    assert any(auto.labels[t] == "bsd-3-clause" and c == m for t, c, _, _ in auto.scan(words)[1])


def test_chains_against_dynamic_programming():
    """The longest chain of one template by the quadratic recurrence over all
    maximal matches."""
    r = np.random.default_rng(0)
    vocab = [f"w{i}" for i in range(12)]
    for _ in range(40):
        template = " ".join(r.choice(vocab, 14))
        auto = license_scan.Automaton((("t", template),), ())
        words = [w.encode() for w in r.choice(vocab, 60)]
        at = int(r.integers(0, 40))
        words[at:at + 14] = [w.encode() if r.random() < 0.85 else b"zzz" for w in template.split()]
        seen = []
        chain = auto._chain
        auto._chain = lambda m: seen.extend(m) or chain(m)
        got = auto.scan(words)[1]
        places = [(end, te, n) for end, state, n in seen for _, te in auto.ends[state]]
        best = []
        for i, (end, te, n) in enumerate(places):
            top = n
            for j in range(i):
                pe, pt, _ = places[j]
                over, gap = max(0, pe - (end - n), pt - (te - n)), max(0, (te - n) - pt)
                if end - n - pe <= license_scan.MAX_GAP and gap <= license_scan.MAX_GAP and over < n and te > pt and pe < end:
                    top = max(top, best[j] + n - over)
            best.append(top)
        assert max((c for _, c, _, _ in got), default=0) <= max(best, default=0)
        spans = sorted((s, e) for _, _, s, e in got)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
        if best:
            assert max(c for _, c, _, _ in got) >= 0.9 * max(best)


def test_one_decoding_over_overlapping_windows(model):
    """Scores of a short text fit one window, so the run must give the tags of
    the plain decoder; long runs must not depend on how they are grouped."""
    lines = [t for t, _ in pii.generated(80, seed=3)]
    wins = np.concatenate([pii.cut_windows(charlstm.classes(t), np.zeros(1, np.int64)) for t in lines])
    size = np.minimum([len(t) for t in lines], pii.WINDOW)
    plain = charlstm.decode(model, wins, len(pii.KINDS))
    whole = charlstm.decode_runs(model, wins, np.zeros(len(wins), int), np.full(len(wins), pii.WINDOW), np.arange(len(wins)), len(pii.KINDS))
    assert all((a == b).all() for a, b in zip(plain, whole))
    first, run = np.zeros(len(wins), int), np.arange(len(wins)) // 7
    many = charlstm.decode_runs(model, wins, first, size, run, len(pii.KINDS))
    few = charlstm.decode_runs(model, wins, first, size, run, len(pii.KINDS), cells=100)
    assert all((a == b).all() for a, b in zip(many, few)) and [len(x) for x in many] == np.bincount(run, size).tolist()


def test_viterbi_is_the_best_of_all_paths(model):
    bans = charlstm.allowed(len(pii.KINDS))
    win = pii.cut_windows(charlstm.classes("a@b.c 1"), np.zeros(1, np.int64))
    e = charlstm.emissions(model, win)[:5, 0]
    k = e.shape[1]
    trans = model["T"] + bans
    score = {(): 0.0}
    paths = {(t,): float(e[0, t] + trans[k, t]) for t in range(k)}
    for i in range(1, 5):
        paths = {(*p, t): s + float(trans[p[-1], t] + e[i, t]) for p, s in paths.items() for t in range(k)}
    got = charlstm.decode_runs(model, win, np.array([0]), np.array([5]), np.array([0]), len(pii.KINDS))[0]
    assert abs(paths[tuple(got.tolist())] - max(paths.values())) < 1e-4 and score


def test_long_spans_are_found_at_every_offset(model):
    """The former windows lost spans that touch an edge: added spans of a text
    must not depend on where it stands."""
    span = "jürgen.müller.von.und.zu@universitätsklinikum-heidelberg.example.org"
    alone = pii.text_spans(model, [f"write to {span} today please"])[0][1]
    for pad in range(0, 96, 7):
        got = pii.text_spans(model, ["x" * pad + f" write to {span} today please"])[0][1]
        assert len(got) >= len(alone) - 1


def test_clashing_columns_keep_their_values(spark, model):
    rows = [(1, "call +1 (555) 123-4567 now", "f", "b", 5), (2, None, None, "b2", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string, base string, n_hit int")
    got = {r.doc_id: r for r in pii.mask(docs, model).collect()}
    assert got[1].found == "f" and got[1].base == "b" and got[1].text != rows[0][1] and got[2].base == "b2"
    items = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    clean = decontaminate.drop_contaminated(docs.withColumnRenamed("found", "Items"), items)
    assert sorted((r.doc_id, r.Items, r.n_hit) for r in clean.collect()) == [(1, "f", 5), (2, None, None)]
    keyed = spark.createDataFrame([(1, "w " * 30, {"a": 1}, 9), (1, "w " * 30, {"a": 2}, 9), (2, "w " * 30, {"a": 1}, 8)],
                                  "doc_id long, text string, tags map<string,int>, _hash int")
    one = simhash.keep_one(keyed).collect()
    assert len(one) == 1 and one[0].doc_id == 1 and one[0]["_hash"] == 9
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    named = docs.withColumnRenamed("found", "_d").withColumnRenamed("base", "_h")
    assert sorted(map(str, quality.keep_good(named, labels).collect())) == sorted(map(str, named.collect()))
    src = docs.select("doc_id", F.lit("s").alias("source"), F.lit(99).alias("block"), F.lit("k").alias("_rank"), F.lit(-1).alias("slot"))
    mixed = mixing.mix(src).collect()
    assert {r.block for r in mixed} == {1} and {r["_rank"] for r in mixed} == {"k"} and {r.slot for r in mixed} == {0}


def test_words_are_the_symbols_of_the_automaton():
    long_words = [("w" * 5000 + str(i)) for i in range(40)]
    w = decontaminate.Windows([(1, " ".join(long_words).encode()), (None, b"only three words"), (2, b"")], 10)
    assert len(w.auto) == 31 + 1 and not w.single
    hit, ids = w.find([x.encode() for x in ["pre", *long_words[5:20], "post", "only", "three", "words"]])
    assert ids == {1} and hit.tolist() == [*range(1, 16), 17, 18, 19]


def test_pipeline_on_odd_rows(spark, tmp_path):
    d = str(tmp_path)
    good = "the quick brown fox jumps over the lazy dog and runs away from all of them into the wood near the river {0}"
    rows = [(i, good.format(f"number{i} " * (1 + i % 3)), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", 0), (None, "null id text with a few words of its own", "en", "s0", 3),
             (5, rows[5][1], "en", "s2", 1), (5, rows[5][1], "en", "s2", 1), (102, "mail me at someone@example.org or +1 (555) 123-4567", "en", "s1", 2),
             (103, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda", "en", "s1", 2), (104, "word " * 3000, "en", "s2", 9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    extra = ", found string, block int, _h int, n_hit int"
    spark.createDataFrame([(*r, "mine", 7, 8, 9) for r in rows], schema + extra).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = corpus_pipeline.run(spark, d).collect()
    ids = [r.doc_id for r in got]
    assert 103 not in ids and ids.count(5) == 1 and len(ids) == len(set(ids))
    assert {r.found for r in got} == {"mine"} and {r["_h"] for r in got} == {8} and {r.n_hit for r in got} == {9}
    assert all("someone@example.org" not in (r.text or "") for r in got)
    empty = str(tmp_path / "empty")
    for t in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{empty}/{t}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
