"""Threshold search with a sup-F statistic, its wild bootstrap and a permutation placebo.

The grid splits the rows into cells; every regime is a union of cells, so one
aggregation per draw replaces the regressions for each candidate.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import Settings
from ..sources.scratch import swept, written
from .moments import Cube, centred, complete, cube, residual_sum, solve

CURVE = "gamma double, f_stat double"
GROUP = 50_000  # rows ranked together


def cell_of(kappa: Column, grid: list[float]) -> Column:
    """Number of grid points below the value: cell c lies above the first c of them."""
    return F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: g < kappa))


def regime(kappa: Column, gamma: float) -> Column:
    return F.when(kappa > gamma, "high").otherwise("low")


def f_curves(cells: np.ndarray, x: list[int], y: int, min_regime: int) -> list[list[float | None]]:
    """The statistic at each grid point from the moments of the cells, for each draw of (draws, cells, k, k);
    ``k`` counts columns, not rank."""
    low = np.cumsum(cells, axis=1)[:, :-1]
    total = cells.sum(axis=1)
    high = total[:, None] - low
    n, k = total[:, None, 0, 0], len(x)
    valid = (low[..., 0, 0] >= min_regime) & (high[..., 0, 0] >= min_regime) & (n > 2 * k)
    split = np.full(valid.shape, np.nan)
    split[valid] = residual_sum(low[valid], x, y) + residual_sum(high[valid], x, y)
    with np.errstate(invalid="ignore", divide="ignore"):
        f = np.where(split > 1e-12 * np.maximum(1.0, total[:, None, y, y]), (residual_sum(total, x, y)[:, None] - split) / k / (split / (n - 2 * k)), np.nan)
    return [[None if math.isnan(v) else v for v in row] for row in f.tolist()]


def f_curve(cells: list[np.ndarray], x: list[int], y: int, min_regime: int) -> list[float | None]:
    return f_curves(np.stack(cells)[None], x, y, min_regime)[0]


def sups(cells: np.ndarray, found: Search) -> list[tuple[int, float, float]]:
    """(draw, sup statistic, gamma) of the draws that have one."""
    y = len(found.controls) + 2
    tops = [best(curve, found.grid) for curve in f_curves(cells, found.x, y, found.min_regime)]
    return [(d, sup, gamma) for d, (gamma, sup) in enumerate(tops, 1) if sup is not None]


def best(curve: list[float | None], grid: list[float]) -> tuple[float | None, float | None]:
    """(gamma, statistic) of the first maximum."""
    known = [(f, -g) for f, g in zip(curve, grid, strict=True) if f is not None and not math.isnan(f)]
    if not known:
        return None, None
    f, g = max(known)
    return -g, f


@dataclass
class Search:
    """What a search keeps for its resampling."""

    rows: DataFrame
    y: str
    kappa: str
    controls: list[str]
    grid: list[float]
    min_regime: int
    mean: dict[str, float]
    cells: list[np.ndarray]
    curve: list[float | None]
    gamma: float | None
    sup: float | None

    @property
    def x(self) -> list[int]:
        return list(range(len(self.controls) + 2))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(zip(self.grid, self.curve, strict=True)), CURVE)


def search(df: DataFrame, y: str, kappa: str, controls: list[str], settings: Settings | None = None) -> Search:
    settings = settings or Settings()
    columns = [kappa, *controls, y]
    return searched(cube(df, columns, cell_of(F.col(kappa).cast("double"), settings.grid), len(settings.grid) + 1), df, y, kappa, controls, settings)


def searched(found: Cube, df: DataFrame, y: str, kappa: str, controls: list[str], settings: Settings) -> Search:
    """:func:`search` from a cube whose cells are those of ``kappa`` on the grid."""
    columns, grid = [kappa, *controls, y], settings.grid
    cells = [m.matrix for m in found.slices(columns)]
    curve = f_curve(cells, list(range(len(controls) + 2)), len(columns), settings.min_regime)
    gamma, sup = best(curve, grid)
    return Search(complete(df, columns), y, kappa, controls, grid, settings.min_regime, found.mean, cells, curve, gamma, sup)


def figure_threshold(df: DataFrame, y: str, kappa: str, controls: list[str], settings: Settings | None = None) -> float:
    """The threshold for figures: a fixed fallback if there are too few rows or no valid point."""
    settings = settings or Settings()
    found = search(df, y, kappa, controls, settings)
    n = sum(c[0, 0] for c in found.cells)
    return settings.fallback_gamma if n < 2 * settings.min_regime or found.gamma is None else found.gamma


BLOCK = 128  # draws that one hash of a row serves


def sign_hashes(key: Column, draws: int) -> list[Column]:
    """Hashes of 128 bits; bit ``j`` of hash ``i``, from the left, is the sign of draw ``BLOCK * i + j + 1`` (0 for +1)."""
    return [F.unhex(F.md5(F.concat_ws("-", key.cast("string"), F.lit(str(i))))).alias(f"h{i}") for i in range(-(-draws // BLOCK))]


def wild_bootstrap(found: Search, key: Column, draws: int) -> list[tuple[int, float, float | None]]:
    """(draw, sup statistic, gamma) with residuals of the pooled model under random signs.

    ``key`` must tell rows apart, else equal ones move together.  The design
    stays, so a draw needs only the sums of signed residuals per cell: each
    task forms them for all draws at once, and only these sums are shuffled.
    """
    if found.gamma is None or draws < 1:
        return []
    total, x, y = np.sum(found.cells, axis=0), found.x, len(found.controls) + 2
    b = solve(total[np.ix_(x, x)], total[x, y])
    terms = [F.lit(1.0), centred(found.kappa, found.mean), *[centred(c, found.mean) for c in found.controls]]
    k, cells = len(terms), len(found.grid) + 1
    hashes = sign_hashes(key, draws)
    blocks = len(hashes)
    cell = cell_of(F.col(found.kappa).cast("double"), found.grid)
    rows = found.rows.select(cell.cast("int").alias("c"), centred(found.y, found.mean).alias("y"), *[t.cast("double").alias(f"x{i}") for i, t in enumerate(terms)], *hashes)

    def run(batches):
        still, moved = np.zeros((cells, k + 2)), np.zeros((cells, draws, k + 1))
        for batch in batches:
            c, y_, *x_ = (np.asarray(batch.column(i)) for i in range(k + 2))
            design = np.stack(x_, axis=1)
            f = design @ b
            r = y_ - f
            raw = [np.frombuffer(b"".join(batch.column(k + 2 + i).to_pylist()), np.uint8).reshape(len(c), -1) for i in range(blocks)]
            bits = np.unpackbits(np.concatenate(raw, axis=1), axis=1)[:, :draws] if len(c) else np.zeros((0, draws))
            sign = (1.0 - 2.0 * bits) * r[:, None]
            wide = np.concatenate((f[:, None], design), axis=1)
            for one in np.unique(c):
                mine = c == one
                still[one] += [(f[mine] ** 2).sum(), (r[mine] ** 2).sum(), *(f[mine] @ design[mine])]
                moved[one] += sign[mine].T @ wide[mine]
        some = np.flatnonzero(still.any(axis=1))
        yield pa.record_batch({"c": pa.array(some, pa.int32()), "m": pa.array([np.concatenate((still[i], moved[i].ravel())) for i in some], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "c int, m array<double>").select("c", F.posexplode("m").alias("at", "v")).groupBy("c", "at").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros((cells, k + 2 + draws * (k + 1)))
    flat[sums["c"].to_numpy(int), sums["at"].to_numpy(int)] = sums["v"].to_numpy(float)
    ff, rr, xf = flat[:, 0], flat[:, 1], flat[:, 2 : k + 2]
    moved = flat[:, k + 2 :].reshape(cells, draws, k + 1)
    own = np.repeat(np.stack(found.cells)[None], draws, axis=0)
    own[:, :, y, y] = ff + rr + 2 * moved[:, :, 0].T
    own[:, :, :k, y] = own[:, :, y, :k] = xf + moved[:, :, 1:].transpose(1, 0, 2)
    return sups(own, found)


def hash_part(hash_: Column, parts: int) -> Column:
    """Part 0 .. ``parts`` - 1 in the order of a hexadecimal hash."""
    return F.floor(F.conv(F.substring(hash_, 1, 7), 16, 10).cast("double") * parts / 16.0**7).cast("int")


def ranked(df: DataFrame, group: list[str], hash_: str, rows: int, size: int = GROUP) -> DataFrame:
    """Add ``rank`` (from 1) in the order of a hexadecimal hash within each group.

    Rows are dealt into parts by the hash's leading digits, which keep its
    order, so no task ranks a whole group.
    """
    parts = max(1, -(-rows // size))
    df = df.withColumn("__part", hash_part(F.col(hash_), parts))
    sizes = df.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    order = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    out = df.join(before, [*group, "__part"])
    place = F.row_number().over(W.partitionBy(*group, "__part").orderBy(hash_))
    return out.withColumn("rank", F.col("__before") + place).drop("__part", "__before")


ROUNDS, PRIME = 6, 2_147_483_647


class Bijection:
    """A permutation of 0 .. ``n`` - 1 for each draw, without a table.

    A place is written as ``left * b + right``; keyed rounds add to one side, modulo its size, a
    quadratic polynomial of the other, so each can be undone.  Places beyond ``n`` are sent on until they
    fall inside.  Keys are digits of a hash of draw and round.
    """

    def __init__(self, n: int, draw: int):
        self.n = n
        self.a = max(1, math.isqrt(max(0, n - 1)) + 1)
        self.b = max(1, -(-n // self.a))
        digits = [hashlib.md5(f"{draw}-{i}".encode()).hexdigest() for i in range(ROUNDS)]
        self.keys = [tuple(int(d[7 * j : 7 * j + 7], 16) for j in range(3)) for d in digits]
        # what a round adds depends on one side alone, so it is worked out once for each of its sqrt(n) values
        self.more = []
        for i, (p, q, r) in enumerate(self.keys):
            x = np.arange(self.a if i % 2 else self.b, dtype=np.int64)
            self.more.append(((x * x % PRIME) * p + x * q + r) % PRIME % (self.b if i % 2 else self.a))

    def once(self, place: np.ndarray, rounds, sign: int) -> np.ndarray:
        left = place // self.b
        right = place - left * self.b
        for i in rounds:
            if i % 2:
                right = self.turned(right, self.more[i][left], sign, self.b)
            else:
                left = self.turned(left, self.more[i][right], sign, self.a)
        return left * self.b + right

    @staticmethod
    def turned(x: np.ndarray, more: np.ndarray, sign: int, size: int) -> np.ndarray:
        """``(x + sign * more) % size`` of numbers below ``size``."""
        x = x + more if sign > 0 else x + (size - more)
        return np.where(x >= size, x - size, x)

    def walked(self, place: np.ndarray, rounds, sign: int) -> np.ndarray:
        out = self.once(place, rounds, sign)
        while (far := out >= self.n).any():
            out[far] = self.once(out[far], rounds, sign)
        return out

    def forward(self, place: np.ndarray) -> np.ndarray:
        return self.walked(place, range(ROUNDS), 1)

    def backward(self, place: np.ndarray) -> np.ndarray:
        return self.walked(place, range(ROUNDS - 1, -1, -1), -1)


HELD = 1_000_000  # values of a column that are sent to the executors
DRAWS = 50  # draws of one exchange; its files are given up before the next
PART = 250_000  # places of a part that meets its values in one task
CODED = 65_536  # different values that are sent as numbers of one or two bytes


def permuted_sums(cells: int, grid: np.ndarray, shift: float, kappa: np.ndarray, rest: list[np.ndarray], where: list[tuple[int, int]], out: np.ndarray) -> None:
    """Add the sums by cell of products of 1, the permuted variable and the other columns."""
    cell = np.searchsorted(grid, kappa, side="left")
    terms = [np.ones(len(kappa)), kappa - shift, *rest]
    for p, (i, j) in enumerate(where):
        out[:, p] += np.bincount(cell, weights=terms[i] * terms[j], minlength=cells)


def placebo(found: Search, key: Column, draws: int, held: int = HELD, part: int = PART) -> list[tuple[int, float, float]]:
    """(draw, sup statistic, gamma) with the threshold variable permuted over all rows, anew for each draw.

    ``key`` must tell rows apart; its hash gives each row a place, and draw d
    gives the row at place i the value of the row at place ``forward(i)`` of
    its :class:`Bijection`.  Up to ``held`` rows the values are sent to the
    executors; beyond, each value is sent to the part of places where it is
    wanted, ``DRAWS`` draws in an exchange.  Values alone are sent, packed and
    in the order of their places (which the receiver works out), in a byte or
    two if there are at most ``CODED`` different ones.  A task meets ``part``
    rows and ``DRAWS`` draws; only sums by cell leave it.
    """
    if draws < 1:
        return []
    n = int(sum(c[0, 0] for c in found.cells))
    columns = [*found.controls, found.y]
    k, cells, grid, shift = len(columns) + 2, len(found.grid) + 1, np.array(found.grid), found.mean[found.kappa]
    rows = found.rows.select(F.md5(F.concat_ws("-", key.cast("string"), F.lit("0"))).alias("h"), F.col(found.kappa).cast("double").alias("k"), *[centred(c, found.mean).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = written(ranked(rows, [], "h", n, min(part, GROUP)).withColumn("place", F.col("rank") - 1).drop("h", "rank"), "places")
    where = [(i, j) for i in range(k) for j in range(i, k)]
    names = ["place", *[f"c{i}" for i in range(k - 2)]]

    def sent(total: np.ndarray, first: int) -> pa.Table:
        d = len(total)
        return pa.table({"d": pa.array(np.repeat(np.arange(first, first + d), cells), pa.int32()), "c": pa.array(np.tile(np.arange(cells), d), pa.int32()), "m": pa.array(list(total.reshape(-1, len(where))), pa.list_(pa.float64()))})

    if n <= held:
        values = rows.select("place", "k").toPandas()
        kappa = np.empty(n)
        kappa[values["place"].to_numpy()] = values["k"].to_numpy()
        shared = rows.sparkSession.sparkContext.broadcast(kappa)

        def here(batches):
            total, way = np.zeros((draws, cells, len(where))), [Bijection(n, d + 1) for d in range(draws)]
            for batch in batches:
                place, *rest = (batch.column(c).to_numpy() for c in names)
                for d in range(draws):
                    permuted_sums(cells, grid, shift, shared.value[way[d].forward(place)], rest, where, total[d])
            yield from sent(total, 0).to_batches()

        spread = rows.select(*names).repartition(max(rows.sparkSession.sparkContext.defaultParallelism, n // GROUP))
        sums = spread.mapInArrow(here, "d int, c int, m array<double>")
    else:
        spark, count = rows.sparkSession, -(-n // part)
        few = [r[0] for r in rows.select("k").distinct().limit(CODED + 1).collect()]
        known = np.sort(np.array(few)) if len(few) <= CODED else None
        kind = np.dtype(np.float64 if known is None else np.uint8 if len(few) <= 256 else np.uint16)
        coded = lambda k: k if known is None else np.searchsorted(known, k).astype(kind)
        columns_ = names[1:]

        def pack(own: pa.Table) -> pa.Table:
            order = np.argsort(own["place"].to_numpy())
            bytes_ = {c: own[c].to_numpy()[order].astype(float).tobytes() for c in columns_}
            return pa.table({"part": pa.array([own["part"][0].as_py()], pa.int32()), "k": pa.array([coded(own["k"].to_numpy()[order]).tobytes()], pa.binary()), **{c: pa.array([v], pa.binary()) for c, v in bytes_.items()}})

        parted = rows.withColumn("part", F.floor(F.col("place") / part).cast("int"))
        packed = parted.groupBy("part").applyInArrow(pack, ", ".join(["part int, k binary", *[f"{c} binary" for c in columns_]]))
        packed = written(packed.repartition(min(count, 4 * spark.sparkContext.defaultParallelism)), "packed")
        fields = pa.schema([("in_part", pa.int32()), ("d", pa.int32()), ("source", pa.int32()), ("v", pa.binary())])

        def exchange(first: int) -> DataFrame:
            some = min(DRAWS, draws - first)

            def away(batches):
                way = [Bijection(n, first + d + 1) for d in range(some)]
                for batch in batches:
                    for source, k in zip(batch.column("part").to_pylist(), batch.column("k").to_pylist(), strict=True):
                        values = np.frombuffer(k, kind)
                        place = np.arange(source * part, source * part + len(values), dtype=np.int64)
                        for d in range(some):
                            to = (way[d].backward(place) // part).astype(np.uint16 if count <= 65_536 else np.int64)
                            sent_ = values[np.argsort(to, kind="stable")]
                            size = np.bincount(to, minlength=count)
                            where_ = np.flatnonzero(size)
                            ends = np.cumsum(size)
                            slices = [sent_[ends[t] - size[t] : ends[t]].tobytes() for t in where_]
                            same = np.full(len(where_), 0, np.int32)
                            yield pa.RecordBatch.from_arrays([pa.array(where_, pa.int32()), pa.array(same + d), pa.array(same + source), pa.array(slices, pa.binary())], schema=fields)

            def met(own: pa.Table, arrived: pa.Table) -> pa.Table:
                rest = [np.frombuffer(own[c][0].as_py(), np.float64) for c in columns_]
                at = own["part"][0].as_py() * part
                place = np.arange(at, at + len(rest[0]), dtype=np.int64)
                d_, source, v = arrived["d"].to_numpy(), arrived["source"].to_numpy(), arrived["v"]
                total = np.zeros((some, cells, len(where)))
                for d in range(some):
                    mine = np.flatnonzero(d_ == d)
                    mine = mine[np.argsort(source[mine])]
                    values = np.frombuffer(b"".join(v[int(i)].as_py() for i in mine), kind)
                    kappa = np.empty(len(place))
                    kappa[np.argsort(Bijection(n, first + d + 1).forward(place))] = values if known is None else known[values]
                    permuted_sums(cells, grid, shift, kappa, rest, where, total[d])
                return sent(total, first)

            own = packed.drop("k")
            arriving = packed.select("part", "k").mapInArrow(away, "in_part int, d int, source int, v binary")
            return own.groupBy("part").cogroup(arriving.groupBy("in_part")).applyInArrow(met, "d int, c int, m array<double>")

        made = []
        for first in range(0, draws, DRAWS):
            made.append(written(exchange(first), "sums"))
            swept(spark)
        sums = reduce(DataFrame.unionByName, made)

    sums = sums.select("d", "c", F.posexplode("m").alias("at", "v")).groupBy("d", "c", "at").agg(F.sum("v").alias("v")).toPandas()
    flat = np.zeros((draws, cells, len(where)))
    flat[sums["d"].to_numpy(int), sums["c"].to_numpy(int), sums["at"].to_numpy(int)] = sums["v"].to_numpy(float)
    full = np.zeros((draws, cells, k, k))
    for p, (i, j) in enumerate(where):
        full[:, :, i, j] = full[:, :, j, i] = flat[:, :, p]
    return sups(full, found)


def draws_frame(spark: SparkSession, draws: list[tuple[int, float, float | None]]) -> DataFrame:
    return spark.createDataFrame(draws, "iter int, sup_f double, gamma double")


def share_at_least(draws: list[tuple[int, float, float | None]], value: float | None) -> float | None:
    """Share of draws that reach a value, without correction."""
    return None if value is None or not draws else sum(s >= value for _, s, _ in draws) / len(draws)


def verdict(p: float | None) -> str:
    """Significance in words."""
    if p is None:
        return "no valid threshold"
    return next((f"significant at {int(100 * level)}%" for level in (0.01, 0.05, 0.10) if p < level), "not significant")


def compare(found: Search, draws: list[tuple[int, float, float | None]]) -> dict[str, float | str | None]:
    """The real threshold against the placebo draws."""
    gammas = np.array([g for _, _, g in draws], float)
    p = share_at_least(draws, found.sup)
    if not len(gammas) or found.gamma is None:
        return {"mean": None, "sd": None, "z": None, "p": None, "verdict": "no comparison"}
    sd = float(gammas.std())
    low, mid, high = (float(x) for x in np.percentile(gammas, [5, 50, 95]))
    return {"mean": float(gammas.mean()), "sd": sd, "median": mid, "p05": low, "p95": high, "z": (found.gamma - float(gammas.mean())) / sd if sd > 0 else None, "p": p, "verdict": "real" if p is not None and p < 0.05 else "may be spurious"}
