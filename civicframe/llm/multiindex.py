"""Embedding near-duplicates over an inverted multi-index.

Vectors are scaled to length 1 and cut into halves, each half with its own
codebook (k-means on a bounded sample); the two nearest codewords are a
vector's cell in the product grid, and every vector is stored in its cell. A
query visits cells in multi-sequence order, by rising sum of the distances of the
two codewords. How many cells it visits is calibrated, not guessed: partners
at exactly the threshold are drawn around the sampled vectors, and the number
is the rank by which the ``target`` share of them has been met (the worst case;
closer partners are met earlier, and a pair is met if either side visits the other).
Each meeting is verified in double precision.

Every vector is a query against all others of its label. Cells are cut into
bounded blocks on both sides, so that a cell or group of any size is spread
over many tasks. A block returns counts per vector and the links of a spanning
forest, never its pairs. A pair that both sides would meet is counted on one
side only. Exact copies are one entry with a count.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components, or has no label, links with nothing (n_links 0, its own
component); vectors of different lengths are compared with none of the other length; repeated
vec_ids are separate rows; a null vec_id takes part but names no component
unless all of its component are null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, land, merge

MIN_COSINE = 0.93
WORDS = 16          # codewords of each half
SAMPLE = 20_000     # vectors the codebooks are fitted on, at most
TARGET = 0.99       # share of threshold partners met from one side
BLOCK = 4096        # rows of a block, about
SEED = 42


def kmeans(x: np.ndarray, k: int, rounds: int = 15, seed: int = SEED) -> np.ndarray:
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = (-2 * x @ c.T + (c * c).sum(1)).argmin(1)
        for i in np.unique(near):
            c[i] = x[near == i].mean(0)
    return c


class Grid:
    """Codebooks of both halves and the number of cells a query visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int):
        self.first, self.second, self.visits = first, second, visits

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sum of both halves' squared distances to each cell (n, cells)."""
        h = len(self.first[0])
        d = []
        for part, c in ((x[:, :h], self.first), (x[:, h:], self.second)):
            d.append((part * part).sum(1)[:, None] - 2 * part @ c.T + (c * c).sum(1))
        return (d[0][:, :, None] + d[1][:, None, :]).reshape(len(x), -1)


def fit(sample: np.ndarray, words: int = WORDS, target: float = TARGET, cosine: float = MIN_COSINE, seed: int = SEED) -> Grid:
    """Codebooks from unit vectors, visits from partners drawn at the threshold."""
    h = sample.shape[1] // 2
    words = max(1, min(words, len(sample)))
    grid = Grid(kmeans(sample[:, :h], words, seed=seed), kmeans(sample[:, h:], words, seed=seed + 1), words * words)
    r = np.random.default_rng(seed)
    q = sample[r.choice(len(sample), min(4000, len(sample)), replace=False)]
    away = r.standard_normal(q.shape)
    away -= (away * q).sum(1)[:, None] * q
    away /= np.maximum(np.linalg.norm(away, axis=1), 1e-12)[:, None]
    partner = cosine * q + np.sqrt(max(0.0, 1 - cosine * cosine)) * away
    s = grid.sums(q)
    home = grid.sums(partner).argmin(1)
    rank = (s < s[np.arange(len(s)), home][:, None]).sum(1) + 1
    grid.visits = int(np.quantile(rank, target, method="higher"))
    return grid


def unit(blobs: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision; blobs hold floats or doubles."""
    wide = bool(blobs) and len(blobs[0]) == 8 * dim
    x = np.frombuffer(b"".join(blobs), "<f8" if wide else "<f4").reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1)[:, None]


def valid_vectors(rows: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, dim, vec binary, nid): usable vectors, floats as they
    are, other numbers as doubles scaled to at most 1 (their norm stays finite);
    nid, the MD5 of vector and label, is equal for exact copies."""
    single = rows.schema[vector].dataType == T.ArrayType(T.FloatType(), rows.schema[vector].dataType.containsNull)
    def run(batches):
        for b in batches:
            ids, labels, dims, vecs = [], [], [], []
            for i, lab, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if lab is None or not v or any(x is None for x in v):
                    continue
                x = np.array(v, "<f8")
                if np.isfinite(x).all() and x.any():
                    x = (x if single else x / np.abs(x).max()) + 0.0
                    ids.append(i)
                    labels.append(lab)
                    dims.append(len(x))
                    vecs.append((x.astype("<f4") if single else x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(dims, pa.int32()),
                                              pa.array(vecs, pa.binary())], names=["vec_id", "label", "dim", "vec"])
    src = rows.select(F.col(id_col).cast("long"), F.col(label).cast("string"), F.col(vector).cast("array<double>"))
    return (src.mapInArrow(run, "vec_id long, label string, dim int, vec binary")
            .withColumn("nid", F.md5(F.concat_ws(":", F.base64("vec"), "label"))))


def place(entries: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """Home cell of each entry, the cells it visits, and these as a bit map."""
    plain = {d: (g.first, g.second, g.visits) for d, g in grids.items()}
    shared = entries.sparkSession.sparkContext.broadcast(plain)

    def run(batches):
        for b in batches:
            dims = np.asarray(b.column("dim"))
            blobs = b.column("vec").to_pylist()
            home = np.zeros(b.num_rows, np.int32)
            visit: list = [None] * b.num_rows
            seen: list = [None] * b.num_rows
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                grid = Grid(*shared.value[dim])
                for s in range(0, len(at), 2048):
                    some = at[s:s + 2048]
                    d = grid.sums(unit([blobs[i] for i in some], dim))
                    order = np.argsort(d, axis=1, kind="stable")[:, :grid.visits].astype(np.int32)
                    bits = np.zeros(d.shape, bool)
                    bits[np.arange(len(d))[:, None], order] = True
                    home[some] = order[:, 0]
                    for i, o, m in zip(some.tolist(), order.tolist(), np.packbits(bits, axis=1)):
                        visit[i], seen[i] = o, m.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(home), pa.array(visit, pa.list_(pa.int32())), pa.array(seen, pa.binary())],
                names=[*b.schema.names, "home", "visit", "seen"])
    return entries.mapInArrow(run, "nid string, n long, label string, dim int, vec binary, home int, visit array<int>, seen binary")


FOUND = "kind int, a string, b string, n long"


def meet(queries: pa.Table, stored: pa.Table, cosine: float) -> pa.Table:
    """Verified links between one block of queries and one block of a cell:
    kind 0 (a, n: rows linked to a), kind 1 links of a spanning forest (a, b)."""
    kind, left, right, count = [], [], [], []
    if queries.num_rows and stored.num_rows:
        dim = queries["dim"][0].as_py()
        ids, rank = np.unique(np.array(queries["nid"].to_pylist() + stored["nid"].to_pylist()), return_inverse=True)
        nq = queries.num_rows
        q_n, s_n = (np.asarray(t["n"]) for t in (queries, stored))
        q_home = np.asarray(queries["home"])
        x, y = unit(queries["vec"].to_pylist(), dim), unit(stored["vec"].to_pylist(), dim)
        seen = np.unpackbits(np.frombuffer(b"".join(stored["seen"].to_pylist()), np.uint8).reshape(len(y), -1), axis=1)
        linked = np.zeros(len(ids), np.int64)
        comp = np.arange(len(ids))
        for at in range(0, nq, 1024):
            a, b = np.nonzero(x[at:at + 1024] @ y.T >= cosine)
            a = a + at
            ra, rb = rank[a], rank[nq + b]
            # a pair that meets from both sides counts where the query is the smaller
            keep = (ra != rb) & ((seen[b, q_home[a]] == 0) | (ra < rb))
            a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
            np.add.at(linked, ra, s_n[b])
            np.add.at(linked, rb, q_n[a])
            apart = comp[ra] != comp[rb]
            if apart.any():
                comp, u, v = merge(comp, ra[apart], rb[apart])
                left += ids[u].tolist()
                right += ids[v].tolist()
        kind, count = [1] * len(left), [0] * len(left)
        some = np.flatnonzero(linked)
        kind += [0] * len(some)
        left += ids[some].tolist()
        right += ids[some].tolist()
        count += linked[some].tolist()
    return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()),
                     "n": pa.array(count, pa.int64())})


def near_duplicates(rows: DataFrame, cosine: float = MIN_COSINE, words: int = WORDS, target: float = TARGET,
                    sample: int = SAMPLE, block: int = BLOCK, id_col: str = "vec_id", vector: str = "embedding",
                    label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    ok = land(valid_vectors(rows, id_col, vector, label), "vectors")
    entries = land(ok.groupBy("nid").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"),
                                         F.first("dim").alias("dim"), F.first("vec").alias("vec")), "entries")
    picked = entries.select("dim", "vec", "nid").orderBy(F.xxhash64("nid", F.lit(SEED)), "nid").limit(sample).collect()
    by_dim: dict[int, list[bytes]] = {}
    for r in picked:
        by_dim.setdefault(r["dim"], []).append(bytes(r["vec"]))
    for d in (r["dim"] for r in entries.select("dim").distinct().collect()):
        if d not in by_dim:
            by_dim[d] = [bytes(r["vec"]) for r in entries.where(F.col("dim") == d).orderBy("nid").limit(sample).select("vec").collect()]
    grids = {d: fit(unit(v, d), words, target, cosine) for d, v in by_dim.items()}
    placed = land(place(entries.select("nid", "n", "label", "dim", "vec"), grids), "placed")

    # blocks of each cell on both sides, from counts without vectors
    at = ["label", "dim", "cell"]
    stored_n = placed.withColumnRenamed("home", "cell").groupBy(*at).agg(F.count(F.lit(1)).alias("sn"))
    asked_n = placed.select("label", "dim", F.explode("visit").alias("cell")).groupBy(*at).agg(F.count(F.lit(1)).alias("qn"))
    blocks = (stored_n.join(asked_n, at)
              .select(*at, F.ceil(F.col("sn") / block).cast("int").alias("sb"), F.ceil(F.col("qn") / block).cast("int").alias("qb")))
    salt = F.xxhash64("nid", F.lit(SEED))
    seq = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    stored = (placed.withColumn("cell", F.col("home")).join(blocks, at)
              .withColumn("s", F.pmod(salt, F.col("sb")).cast("int")).withColumn("q", F.explode(seq("qb")))
              .select(*at, "s", "q", "nid", "n", "vec", "home", "seen"))
    asked = (placed.withColumn("cell", F.explode("visit")).join(blocks, at)
             .withColumn("q", F.pmod(salt, F.col("qb")).cast("int")).withColumn("s", F.explode(seq("sb")))
             .select(*at, "s", "q", "nid", "n", "vec", "home", "seen"))
    key = [*at, "s", "q"]
    asked = asked.select(*(F.col(c).alias(c) for c in asked.columns))  # columns of its own for the cogroup

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        return meet(left, right, cosine)
    found = land(asked.groupBy(*key).cogroup(stored.groupBy(*key)).applyInArrow(verify, FOUND), "met")

    linked = found.where("kind = 0").groupBy(F.col("a").alias("nid")).agg(F.sum("n").alias("links"))
    comp = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "nid")
    named = (entries.select("nid", "low", "n").join(linked, "nid", "left").join(comp, "nid", "left")
             .withColumn("comp", F.coalesce("comp", "nid")))
    lows = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    per_key = named.join(lows, "comp").select("nid", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    usable = ok.select("vec_id", "nid").join(per_key, "nid").select("vec_id", "n_links", "component_id")
    return (usable.union(_unusable(rows, id_col, vector, label))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))


def _unusable(rows: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0)
    return (rows.where(~F.coalesce(good, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                    F.col(id_col).cast("long").alias("component_id")))
