"""The most similar vectors of every vector: randomly rotated one-bit codes with error bounds."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import heavy_keys, salted_join
from ..session import spread, stage

#: Rows of the hash-ordered sample on which centroids are fitted and probes chosen; the index holds every row.
TRAIN_ROWS = 20_000
#: Sampled queries that choose the number of probed cells, and the share of their true neighbours these must hold.
TUNE_QUERIES, TUNE_SHARE = 400, 0.95
#: Most cells; rows of a block on either side; bits of a query component; width of the error bound.
CELLS_MOST, BLOCK, QUERY_BITS, EPSILON = 4096, 8192, 4, 1.9
#: With a least cosine: cells to the root of the rows, room beyond the widest gap of sampled pairs, width of the error
#: bound (the threshold is fixed, so a pair is lost where it fails), and asks of a round, at most so many a row or in all.
CELLS_ROOT, GAP_ROOM, EPSILON_LEAST, ROUND_EACH, ROUND_LEAST = 2.0, 0.05, 4.5, 4, 1 << 20
#: Rows multiplied with the centroids at a time, and pairs compared exactly at a time.
STRETCH, PAIRS = 1024, 1 << 16
#: Index rows whose largest lower bound stands for them when the k-th best is sought.
STRIP = 16
SEED = 20190304


@dataclass(frozen=True)
class Index:
    """What every task needs: of a size bounded by CELLS_MOST and the dimension.

    A row looks into its ``probes`` nearest cells or, where ``gap`` is given, into all cells whose
    centroids are at most that much less similar than the nearest.
    """

    centroids: np.ndarray
    rotation: np.ndarray
    probes: int
    gap: float | None = None


def _matrix(col, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _lists(m: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def _binaries(m: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes as binary values."""
    ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(m).tobytes())])


def _bytes(col) -> np.ndarray:
    """Binary values of one length as the rows of a matrix."""
    a = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    a = pa.concat_arrays(a.chunks) if isinstance(a, pa.ChunkedArray) else a
    ends = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(len(a), -1)


def _unit(col, dim: int) -> np.ndarray:
    m = _matrix(col, dim)
    return m / np.sqrt((m * m).sum(1))[:, None]


def _usable(dim: int):
    """Of rows (id, v) those whose v is of finite numbers that are not all zero, with a number that tells the direction."""

    def run(batches):
        for b in batches:
            m = _matrix(b.column("v"), dim)  # null elements become NaN
            with np.errstate(all="ignore"):
                norm = np.sqrt((m * m).sum(1))
                ok = np.isfinite(m).all(1) & (norm > 0)
                u = np.rint(m[ok] / norm[ok, None] * 1e5).astype(np.int32)
            way = [int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little", signed=True) for x in u]
            kept = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([kept.column("id"), kept.column("v"), pa.array(way, pa.int64())], ["id", "v", "dir"])

    return run


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, v, dir): each id once, only vectors of ``dim`` finite numbers that are not all zero; vectors of one direction, to five places, have one dir."""
    numbers = dict(df.dtypes)[vector]
    x = df.select(F.col(key).alias("id"), F.col(vector).cast(numbers if numbers == "array<float>" else "array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
    kinds = dict(x.dtypes)
    x = x.mapInArrow(_usable(dim), f"id {kinds['id']}, v {kinds['v']}, dir long")
    return x.groupBy("id").agg(F.min(F.struct("v", "dir")).alias("x")).select("id", "x.v", "x.dir")


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row and its similarity."""
    near, best = np.empty(len(x), np.int64), np.empty(len(x), np.float32)
    x, c = x.astype(np.float32), c.astype(np.float32)
    for a in range(0, len(x), STRETCH):
        s = x[a : a + STRETCH] @ c.T
        near[a : a + STRETCH] = s.argmax(1)
        best[a : a + STRETCH] = s.max(1)
    return near, best


def _gap(x: np.ndarray, c: np.ndarray, least: float) -> float:
    """How much less similar than the nearest centroid that of a partner is, for the one or the other of each pair of the sample."""
    (near, best), widest = _nearest(x, c), 0.0
    x, c = x.astype(np.float32), c.astype(np.float32)
    for a in range(0, len(x), STRETCH):
        i, j = np.nonzero(x[a : a + STRETCH] @ x.T >= least)
        i = i + a
        for p in range(0, len(i), PAIRS):
            y, z = i[p : p + PAIRS], j[p : p + PAIRS]
            there, back = best[y] - np.einsum("ij,ij->i", x[y], c[near[z]]), best[z] - np.einsum("ij,ij->i", x[z], c[near[y]])
            widest = max(widest, float(np.minimum(there, back).max()))
    return widest


def fit(vectors: DataFrame, n: int, dim: int, k: int, least: float | None = None) -> Index:
    """Spherical k-means and what is probed, on a sample of at most TRAIN_ROWS rows."""
    x = _unit(vectors.orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS).select("v").toArrow().column("v"), dim)
    rng = np.random.default_rng(SEED)
    cells = int(max(1, min(CELLS_MOST, np.sqrt(n) * (0.5 if least is None else CELLS_ROOT), len(x))))
    c = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(12):
        near = _nearest(x, c)[0]
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(length > 1e-9, total / np.maximum(length, 1e-9), c)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    if least is not None:
        return Index(c, rotation, cells, _gap(x, c, least) + GAP_ROOM)
    near = _nearest(x, c)[0]
    q = x[:TUNE_QUERIES]
    sim = q @ x.T
    sim[np.arange(len(q)), np.arange(len(q))] = -2
    best = np.argsort(-sim, axis=1)[:, : min(k, max(1, len(x) - 1))]
    order = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)  # the rank of each cell for each query
    ranks = np.sort(np.take_along_axis(order, near[best], axis=1).ravel())
    probes = int(ranks[min(len(ranks) - 1, int(TUNE_SHARE * len(ranks)))]) + 1 if len(ranks) else 1
    return Index(c, rotation, min(cells, probes))


def _code(ix: Index, dim: int):
    """(id, v) to the index row: cell, packed sign bits of the rotated residual, its length and the code's correction, and the cells to probe."""

    cells = ix.centroids.T.astype(np.float32)

    def run(batches):
        for b in (b.slice(a, STRETCH) for b in batches for a in range(0, len(b), STRETCH)):
            v = _unit(b.column("v"), dim)
            s = v.astype(np.float32) @ cells
            cell = np.argmax(s, axis=1)
            if ix.gap is None:
                probe = _lists(np.argsort(-s, axis=1, kind="stable")[:, : ix.probes].astype(np.int32))
            else:
                i, j = np.nonzero(s >= s.max(1)[:, None] - np.float32(ix.gap))
                probe = pa.ListArray.from_arrays(pa.array(np.searchsorted(i, np.arange(len(v) + 1)).astype(np.int32)), pa.array(j.astype(np.int32)))
            r = (v - ix.centroids[cell]) @ ix.rotation.T
            length = np.linalg.norm(r, axis=1)
            bits = r > 0
            code = np.packbits(bits, axis=1)
            fix = np.abs(r).sum(1) / np.sqrt(dim) / np.maximum(length, 1e-12)  # <code, residual> of unit vectors
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("v"), pa.array(cell.astype(np.int32)), _binaries(code), pa.array(length.astype(np.float32)), pa.array(fix.astype(np.float32)), probe],
                ["id", "v", "cell", "code", "len", "fix", "probe"],
            )

    return run


def _block(ix: Index, dim: int, k: int, least: float | None = None):
    """Of the queries and the index rows of one block the k best index rows of each query, with ``least`` those of at least that cosine."""
    rotated, schema = ix.centroids @ ix.rotation.T, pa.schema([("q", pa.int64()), ("id", pa.int64()), ("sim", pa.float64())])
    width = EPSILON if least is None else EPSILON_LEAST

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return schema.empty_table()
        x, ids = _unit(rows.column("v"), dim), rows.column("id").to_numpy()
        bits = np.unpackbits(_bytes(rows.column("code")), axis=1)[:, :dim].astype(np.float32)
        length, fix = rows.column("len").to_numpy().astype(np.float32), np.maximum(rows.column("fix").to_numpy(), 1e-6).astype(np.float32)
        part, wide = length / fix, length * np.sqrt(np.maximum(0, 1 - fix**2)) / fix * np.float32(width / np.sqrt(max(1, dim - 1)))
        # the estimate and its bounds are sums of products of what a query and a row have: one matrix product for a block
        have = np.column_stack([part[:, None] * bits, part * bits.sum(1), part, length**2 / 2, np.ones_like(part), wide]).astype(np.float32).T.copy()
        qv, qid, at, tau = _unit(queries.column("qv"), dim), queries.column("qid").to_numpy(), queries.column("cell").to_numpy(), queries.column("tau").to_numpy().astype(np.float32)
        out, root = [], np.sqrt(dim)
        for a in range(0, len(qid), 256):
            v, me = qv[a : a + 256], qid[a : a + 256]
            r = v @ ix.rotation.T - rotated[at[a : a + 256]]
            size = np.linalg.norm(r, axis=1)
            u = r / np.maximum(size, 1e-12)[:, None]
            low = u.min(1)
            step = np.maximum((u.max(1) - low) / (2**QUERY_BITS - 1), 1e-12)
            level = np.rint((u - low[:, None]) / step[:, None])

            def bound(sign: int) -> np.ndarray:
                # <sign code, query> from the bits and levels, over <sign code, own residual>; then the cosine
                own = np.column_stack([level * (size * 2 * step / root)[:, None], size * 2 * low / root, size * (sign * width * step / np.sqrt(12) - u.sum(1) / root), -np.ones_like(size), 1 - size**2 / 2, sign * size])
                return own.astype(np.float32) @ have

            most, low_at = bound(1), tau[a : a + 256] - np.float32(1e-5)
            can = most >= low_at[:, None]
            if least is None or np.count_nonzero(can) > 8 * k * len(me):
                floor = bound(-1)
                floor[me[:, None] == ids[None, :]] = -2
                # the k-th largest of the maxima of strips is at most the k-th largest
                strips = np.maximum.reduceat(floor, np.arange(0, len(ids), STRIP), axis=1)
                kth = np.partition(strips, -k, axis=1)[:, -k] if strips.shape[1] >= k else np.full(len(me), -2, np.float32)
                can = most >= np.maximum(kth - np.float32(1e-5), low_at)[:, None]
            i, j = np.nonzero(can)
            other = me[i] != ids[j]
            i, j = i[other], j[other]
            sim = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", v[i[p : p + PAIRS]], x[j[p : p + PAIRS]]) for p in range(0, len(i), PAIRS)]])
            sim = np.round(sim, 7)
            if least is not None:
                near = sim >= least
                i, j, sim = i[near], j[near], sim[near]
            order = np.lexsort((ids[j], -sim, i))
            i, j, sim = i[order], j[order], sim[order]
            first = np.r_[0, 1 + np.flatnonzero(i[1:] != i[:-1])] if len(i) else np.zeros(0, np.int64)
            rank = np.arange(len(i)) - np.repeat(first, np.diff(np.r_[first, len(i)]))
            top = rank < k
            out.append(pa.table([pa.array(me[i[top]]), pa.array(ids[j[top]]), pa.array(sim[top])], schema=schema))
        return pa.concat_tables(out)

    return run


def neighbours(df: DataFrame, key: str, vector: str, dim: int = 64, k: int = 5, least: float | None = None) -> DataFrame:
    """(id, neighbour, rank, sim): the k rows of highest cosine to each usable row, with ``least`` those of at least that cosine.

    Rows of an id count once; vectors that are null, of another length, all zero or not finite are
    in no pair. Equal cosines, to seven places, rank by the smaller id. Equal directions are
    indexed once: only the k + 1 smallest ids of a direction can be anyone's neighbours, so copies
    cost no pairs. Every direction is coded in the cell of its nearest centroid; a query looks at
    its nearest cells, as many as hold TUNE_SHARE of the neighbours of sampled queries. Cells are
    worked on in blocks of at most BLOCK rows and queries, so a cell that holds a third of the rows
    is many blocks. In a block the bounds of the estimates choose which vectors are compared.

    With ``least`` a pair needs no k-th best to be known: a row looks into the cells whose centroids
    come close enough to its nearest for all pairs of that cosine in the sample, and a pair counts
    for both its rows, whichever of them looked. The asks go in rounds, so that what is shuffled at
    a time stays in proportion to the rows.
    """
    rows = stage(usable(spread(df.select(key, vector).where(F.col(key).isNotNull()), key), key, vector, dim))
    first = Window.partitionBy("dir").orderBy("id")
    lead = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1)
    reps = stage(lead.groupBy("dir").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v")).withColumn("id", F.col("ids")[0]))
    n = reps.count()
    if not n:
        return df.sparkSession.createDataFrame([], "id long, neighbour long, rank int, sim double")
    ix = fit(reps, n, dim, k, least)
    coded = stage(reps.select("id", "v").mapInArrow(_code(ix, dim), f"id long, v {dict(reps.dtypes)['v']}, cell int, code binary, len float, fix float, probe array<int>"))
    # one row per cell, at most CELLS_MOST
    inside = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}
    asked = {r["c"]: r["count"] for r in coded.select(F.explode("probe").alias("c")).groupBy("c").count().collect()}
    h = lambda of: F.pmod(F.xxhash64("id"), F.col(of)).cast("int")

    def look(asks: DataFrame, queries: dict[int, int]) -> DataFrame:
        """The k best of each ask (id, v, tau, cell) in its cell; ``queries`` counts the asks of the cells."""
        parts = [(int(c), -(-n // BLOCK), -(-queries[c] // BLOCK)) for c, n in inside.items() if queries.get(c)]
        grid = F.broadcast(df.sparkSession.createDataFrame(parts, "cell int, ni int, nq int"))
        index = coded.join(grid, "cell").select("id", "v", "code", "len", "fix", "cell", h("ni").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("j"))
        asks = asks.join(grid, "cell").select(F.col("id").alias("qid"), F.col("v").alias("qv"), "tau", "cell", h("nq").alias("j"), F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"))
        return asks.groupBy("cell", "i", "j").cogroup(index.groupBy("cell", "i", "j")).applyInArrow(_block(ix, dim, k, least), "q long, id long, sim double")

    if least is not None:
        rounds = -(-sum(asked.values()) // max(ROUND_EACH * n, ROUND_LEAST))
        mine = [coded.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(rounds)) == i) for i in range(rounds)]
        met = [stage(look(x.select("id", "v", F.lit(float(least)).alias("tau"), F.explode("probe").alias("cell")), asked)) for x in mine]
        met = reduce(DataFrame.unionByName, met)
        met = met.unionByName(met.select(F.col("id").alias("q"), F.col("q").alias("id"), "sim")).groupBy("q", "id").agg(F.max("sim").alias("sim"))
    else:
        # the nearest cell first: what it finds bounds what the other cells must beat
        own = stage(look(coded.select("id", "v", F.lit(-2.0).alias("tau"), F.col("probe")[0].alias("cell")), inside))
        tau = own.groupBy("q").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(-F.col("sim"))).alias("s")).where(F.col("n") >= k).select(F.col("q").alias("id"), (-F.col("s")[k - 1]).alias("tau"))
        more = coded.select("id", "v", "probe").join(tau, "id", "left").select("id", "v", F.coalesce("tau", F.lit(-2.0)).alias("tau"), F.explode(F.slice("probe", 2, ix.probes)).alias("cell"))
        met = stage(own.unionByName(look(more, {c: n - inside.get(c, 0) for c, n in asked.items()}))) if ix.probes > 1 else own
        # queries whose cells hold too few rows look into every cell
        few = met.groupBy("q").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, n - 1)).select(F.col("q").alias("id"))
        few = stage(coded.select("id", "v").join(few, "id", "left_anti"))
        if ix.probes < len(ix.centroids) and few.limit(1).count():
            ids_few = few.select("id", "v", F.lit(-2.0).alias("tau"), F.explode(F.array(*[F.lit(c) for c in inside])).alias("cell"))
            met = met.join(few.select(F.col("id").alias("q")), "q", "left_anti").unionByName(look(ids_few, dict.fromkeys(inside, few.count())))
    best = met.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "id"))).where(F.col("r") <= k).select("q", "id", "sim")
    # the k + 1 best ids of each direction, itself included: bounded by (k + 1)^2 before they are sorted
    ids = reps.select("id", "ids", "dir")
    pool = best.join(ids.select("id", "ids"), "id").select("q", "sim", F.explode("ids").alias("c")).unionByName(ids.select(F.col("id").alias("q"), F.lit(1.0).alias("sim"), F.explode("ids").alias("c")))
    entry = F.struct((-F.col("sim")).alias("s"), F.col("c").alias("c"))
    pool = pool.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k + 1).alias("pool")).join(ids.select(F.col("id").alias("q"), "dir"), "q").select("dir", "pool")
    members = rows.select("id", "dir")
    each = salted_join(members, pool, "dir", "id", heavy=heavy_keys(members, "dir"))
    mine = F.slice(F.filter("pool", lambda e: e["c"] != F.col("id")), 1, k)
    return each.select("id", F.posexplode(mine).alias("p", "e")).select("id", F.col("e.c").alias("neighbour"), (F.col("p") + 1).alias("rank"), (-F.col("e.s")).alias("sim"))


def similar_pairs(near: DataFrame, least: float) -> DataFrame:
    """(id_a, id_b, sim) with id_a < id_b of the neighbour rows with at least the cosine ``least``."""
    p = near.where(F.col("sim") >= least).select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b"), "sim")
    return p.groupBy("id_a", "id_b").agg(F.max("sim").alias("sim"))
