"""Embedding near-duplicates with product quantisation.

Coarse inverted lists (k-means on unit vectors), residual subspace codes,
asymmetric table lookups, exact cosine rerank.  Two bounds make the search
lose nothing: a list is probed whenever the bisecting plane between its
centre and the query's own is near enough for a linked vector to lie beyond
it, and a lookup distance rejects a vector only by more than its known
quantisation error.  Identical vectors are one class from the start.

The codebooks are fitted on at most ``sample`` vectors per dimension count
(the documented bound); every vector is indexed.  The lists of a label are
laid out one after another, near ones together, and cut into tiles of about
a twelfth of the label.  Two tiles meet in one task if a vector of the first
probes a list of the second, so a vector is sent at most 13 times however
many lists it probes (labels of over 12 * 32,768 vectors: once per tile, as
tiles grow no further).  A meeting sends on counts and a spanning set of its
links, never all pairs.

Defined results: vectors that are null, empty, zero or hold null or
non-finite components, and those without label, link with nothing and are
their own component; vectors of different dimension never link; repeated
rows link with each other; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, small_batches, tidy, written
from .components import components

TILES = 12  # tiles of a label, as long as their size stays between these two
SMALLEST, LARGEST = 2_048, 32_768
CHUNK = 1024
KNOWN = 4_096  # tiles whose probed lists a task remembers at a time
ROW = "label string, dim int, cell int, id long, k long, vec binary, codes binary, err double"


@dataclass(frozen=True)
class Codebook:
    centres: np.ndarray  # (lists, dim)
    words: np.ndarray  # (subspaces, codes, dim / subspaces), on padded dimensions
    gap: np.ndarray  # distances between centres


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rnd = np.random.default_rng(seed)
    centres = x[rnd.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def chained(centres: np.ndarray) -> np.ndarray:
    """The centres in an order in which each is followed by the nearest that is left."""
    order, left = [0], np.ones(len(centres), bool)
    left[0] = False
    while left.any():
        d2 = ((centres - centres[order[-1]]) ** 2).sum(axis=1)
        order.append(int(np.argmin(np.where(left, d2, np.inf))))
        left[order[-1]] = False
    return centres[order]


def pad(x: np.ndarray, subspaces: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, -x.shape[1] % subspaces)))


def fit_codebook(x: np.ndarray, lists: int, subspaces: int, codes: int, seed: int = 5) -> Codebook:
    x = unit(x)
    centres = chained(kmeans(x, lists, 8, seed))
    own = np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)
    rest = pad(x - centres[own], subspaces).reshape(len(x), subspaces, -1)
    words = [kmeans(np.ascontiguousarray(rest[:, s]), codes, 6, seed + s) for s in range(subspaces)]
    gap = np.sqrt(np.maximum(0, ((centres[:, None] - centres[None]) ** 2).sum(axis=2)))
    return Codebook(centres, np.stack(words), gap)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(book: Codebook, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own list, codes, quantisation error) of unit vectors."""
    own = np.argmin((book.centres**2).sum(axis=1) - 2 * x @ book.centres.T, axis=1)
    subspaces = len(book.words)
    rest = pad(x - book.centres[own], subspaces).reshape(len(x), subspaces, -1)
    codes = np.stack([np.argmin((book.words[s] ** 2).sum(axis=1) - 2 * rest[:, s] @ book.words[s].T, axis=1) for s in range(subspaces)], axis=1)
    back = np.stack([book.words[s][codes[:, s]] for s in range(subspaces)], axis=1)
    return own, codes.astype(np.uint8), np.sqrt(((rest - back) ** 2).sum(axis=(1, 2)))


def probes(book: Codebook, x: np.ndarray, reach: float) -> np.ndarray:
    """Lists (a mask) that can hold a vector within ``reach`` of a unit vector."""
    d2 = np.maximum(0, (x * x).sum(axis=1, keepdims=True) + (book.centres**2).sum(axis=1) - 2 * x @ book.centres.T)
    own = np.argmin(d2, axis=1)
    ahead = (d2 - d2[np.arange(len(x)), own][:, None]) / np.maximum(2 * book.gap[own], 1e-12)
    return ahead <= reach + 1e-9


def usable(vec: Column) -> Column:
    # null components make the tests below null, hence false
    fine = F.forall(vec, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(vec) > 0) & fine & F.exists(vec, lambda v: v != 0), F.lit(False))


def tile_links(x: np.ndarray, n: np.ndarray, ids: np.ndarray, cell: np.ndarray, codes: np.ndarray, err: np.ndarray, q: np.ndarray, m: np.ndarray, book: Codebook | None, least: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Number of vectors linked to each row, and a spanning set of the links between the rows ``q`` and
    the rows ``m``, which are either the same rows or have none in common."""
    reach = np.sqrt(2 - 2 * least)
    x, same = unit(x), len(q) and len(m) and q[0] == m[0]
    links, root, tree = np.zeros(len(x), np.int64), np.arange(len(x)), []
    lists = {int(c): m[cell[m] == c] for c in np.unique(cell[m])}
    words = book.words if book else np.zeros((0, 1, 1))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def meet(asks: np.ndarray, held: np.ndarray, centre: np.ndarray) -> None:
        d2 = np.zeros((len(asks), len(held)))
        rest = pad(x[asks] - centre, len(words)).reshape(len(asks), len(words), -1) if len(words) else None
        for s in range(len(words)):
            table = (rest[:, s] ** 2).sum(axis=1, keepdims=True) + (words[s] ** 2).sum(axis=1) - 2 * rest[:, s] @ words[s].T
            d2 += np.take(table, codes[held, s], axis=1)
        near = d2 <= (reach + err[held] + 1e-6) ** 2
        near &= ids[asks][:, None] != ids[held]
        i, j = np.nonzero(near)
        for lo in range(0, len(i), 65536):
            a, b = i[lo : lo + 65536], j[lo : lo + 65536]
            good = (x[asks[a]] * x[held[b]]).sum(axis=1) >= least
            a, b = a[good], b[good]
            if not len(a):
                continue
            links[asks] += np.bincount(a, weights=n[held[b]], minlength=len(asks)).astype(np.int64)
            if not same:
                links[held] += np.bincount(b, weights=n[asks[a]], minlength=len(held)).astype(np.int64)
            for flat in np.unique(asks[a] * len(x) + root[held[b]]).tolist():
                o, p = divmod(flat, len(x))
                r1, r2 = find(o), find(p)
                if r1 != r2:
                    root[max(r1, r2)] = min(r1, r2)
                    tree.append((o, p))

    for at in range(0, len(q), CHUNK):
        part = q[at : at + CHUNK]
        probe = probes(book, x[part], reach) if book else np.ones((len(part), 1), bool)
        for c, own in lists.items():
            asks = part[probe[:, c]]
            for lo in range(0, len(own) if len(asks) else 0, SMALLEST):
                meet(asks, own[lo : lo + SMALLEST], book.centres[c] if book else np.zeros(x.shape[1]))
    return links, tree


def tiles(placed: DataFrame) -> DataFrame:
    """``label, dim, cell, n, before, size`` of each list: the rows in front of it in its label, and the size of a tile there."""
    own = W.partitionBy("label", "dim")
    before = F.coalesce(F.sum("n").over(own.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    size = F.least(F.lit(LARGEST), F.greatest(F.lit(SMALLEST), F.ceil(F.sum("n").over(own) / TILES)))
    return placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n")).withColumns({"before": before, "size": size})


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.93, sample: int = 20_000, lists: int | None = None, subspaces: int = 8, codes: int = 64) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row."""
    spark = vectors.sparkSession
    small_batches(spark)
    narrow = vectors.schema[vec_col].dataType.simpleString() == "array<float>"  # sent as they are, compared in double precision
    kind = np.float32 if narrow else np.float64
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<float>" if narrow else "array<double>").alias("vec"))
    good = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vec")))
    classes = written(good.groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("k")).withColumn("dim", F.size("vec")), "vectors")

    books: dict[int, Codebook] = {}
    sizes = classes.groupBy("dim").count().collect()
    for dim, n in sizes:
        rate = min(1.0, sample / n)
        picked = classes.filter(F.col("dim") == dim)
        if rate < 1:
            picked = picked.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(rate * 1_000_000))
        x = np.array([r[0] for r in picked.select("vec").limit(2 * sample).collect()], float).reshape(-1, dim)
        if len(x):
            books[dim] = fit_codebook(x, lists or max(1, min(1024, int(np.sqrt(n / 4)))), min(subspaces, dim), codes)
    shared = spark.sparkContext.broadcast(books)
    reach = float(np.sqrt(2 - 2 * least))

    def place(batches):
        for batch in batches:
            label, dims, ids, k = (np.array(batch.column(c).to_pylist(), object if c == 0 else np.int64) for c in (0, 1, 2, 3))
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                x = np.array([batch.column(4)[int(i)].as_py() for i in mine], kind)
                book = shared.value.get(int(dim))
                if book is None:
                    own, code, err = np.zeros(len(x), int), np.zeros((len(x), 0), np.uint8), np.full(len(x), 2.0)
                else:
                    own, code, err = encode(book, unit(x))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(label[mine], pa.string()), pa.array(np.full(len(x), dim), pa.int32()), pa.array(own, pa.int32()), pa.array(ids[mine], pa.int64()),
                     pa.array(k[mine], pa.int64()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(err, pa.float64())],
                    names=["label", "dim", "cell", "id", "k", "vec", "codes", "err"],
                )

    placed = written(classes.select("label", "dim", "id", "k", "vec").mapInArrow(tidy(place), ROW), "placed")
    cells = written(tiles(placed), "cells")
    tile = F.floor((F.col("before") + F.pmod(F.xxhash64("id"), F.col("n"))) / F.col("size")).cast("int")
    dealt = written(placed.join(cells, ["label", "dim", "cell"]).withColumn("tile", tile).drop("n", "before", "size"), "dealt")
    dropped(placed)

    def reached(batches):
        """The lists that the vectors of a tile probe."""
        seen: dict[tuple[str, int, int], np.ndarray] = {}

        def told() -> pa.RecordBatch:
            rows = [(*key, int(c)) for key, mask in seen.items() for c in np.flatnonzero(mask)]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))], names=["label", "dim", "q", "cell"])

        for batch in batches:
            label, dims, at, vec = (batch.column(c).to_pylist() for c in range(4))
            places: dict[tuple[str, int, int], list[int]] = {}
            for i, key in enumerate(zip(label, dims, at, strict=True)):
                places.setdefault(key, []).append(i)
            for key, mine in places.items():
                book = shared.value.get(key[1])
                mask = probes(book, unit(np.frombuffer(b"".join(vec[i] for i in mine), kind).reshape(len(mine), -1)), reach).any(axis=0) if book else np.ones(1, bool)
                seen[key] = seen[key] | mask if key in seen else mask
            if len(seen) > KNOWN:
                yield told()
        yield told()

    wanted = dealt.select("label", "dim", "tile", "vec").mapInArrow(tidy(reached), "label string, dim int, q int, cell int").distinct()
    held = dealt.select("label", "dim", "cell", F.col("tile").alias("m")).distinct()
    # a link is found from either end, so the first tile of a pair asks
    meets = written(wanted.join(held, ["label", "dim", "cell"]).filter("q <= m").select("label", "dim", "q", "m").distinct(), "meets")
    asks = meets.select("label", "dim", "q", "m", F.col("q").alias("tile"), F.when(F.col("q") == F.col("m"), 2).otherwise(1).alias("role"))
    sides = asks.unionByName(meets.filter("q < m").select("label", "dim", "q", "m", F.col("m").alias("tile"), F.lit(0).alias("role")))
    to = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("other", pa.int64())])

    def compare(block: pa.Table) -> pa.Table:
        """Links between two tiles; role 1 asks, 0 is asked, 2 is both."""
        role, dim = block["role"].to_numpy(), block["dim"][0].as_py()
        vec = np.frombuffer(b"".join(block["vec"].to_pylist()), kind).reshape(-1, dim)
        code = np.frombuffer(b"".join(block["codes"].to_pylist()), np.uint8).reshape(len(vec), -1)
        ids = block["id"].to_numpy()
        links, tree = tile_links(vec, block["k"].to_numpy(), ids, block["cell"].to_numpy(), code, block["err"].to_numpy(), np.flatnonzero(role > 0), np.flatnonzero(role != 1), shared.value.get(dim), least)
        some = np.flatnonzero(links)
        ends = np.array(tree, np.int64).reshape(-1, 2)
        a = np.concatenate((ids[some], ids[ends[:, 0]]))
        b = np.concatenate((links[some], np.zeros(len(ends), np.int64)))
        o = pa.array([None] * len(some) + ids[ends[:, 1]].tolist(), pa.int64())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), o], schema=to)

    met = dealt.join(sides, ["label", "dim", "tile"]).select("label", "dim", "q", "m", "role", "cell", "id", "k", "vec", "codes", "err")
    found = written(met.groupBy("label", "dim", "q", "m").applyInArrow(compare, "id long, n long, other long"), "near")
    dropped(dealt)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = classes.select("label", "vec", "id", "k").join(counts, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    known = written(known.select("label", "vec", (F.col("k") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("component_id")), "classes")
    fit = F.when(usable(F.col("vec")) & F.col("vec_id").isNotNull(), F.col("label"))
    out = rows.withColumn("label", fit).join(known, ["label", "vec"], "left")
    root = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), F.col("vec_id").eqNullSafe(root).alias("kept"))
