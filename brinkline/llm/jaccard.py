"""N-gram Jaccard join with parity sketches.

A document's set of word shingles is hashed into a bit sketch by XOR: each
shingle flips one bit, so the Hamming distance of two sketches is at most the
size of the symmetric difference of the sets.  Per size band the sketch is cut
into so many sections that two documents which link agree in more than
``slack`` of them (pigeonhole).  A section's key is a hash of its bits (each
section has 2**20, kept sparsely).  Because more than ``slack`` sections agree,
each document may leave out that many keys, the most frequent ones in one
order for all: the rarest key that two linked documents share then remains in
both.  What stands in many documents, as common lines do, thus makes no
candidates.

Documents that share a remaining key form a run.  First each document is held
against one other of its runs, verified exactly on the shingle sets; then, while
that finds links, against the nearest of a run in another component, by the
Hamming distance of short sketches; in the end all pairs of a run that are
still in different components and that sizes and sketches allow.  So no link
that matters to the components is lost and a group of n near copies costs
about n verified pairs.  Documents with equal sets are one class from the start.

Defined results: null or blank text has no shingles and is its own
component; a text of fewer words than a shingle has one, the whole sequence;
rows without id take part in nothing and get a null component; repeated ids
are one node.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, small_batches, swept, tidy, written
from .components import components
from .words import U, drawn_base, hashed_words, mix, shingles

BAND_RATIO = 1.7
SLACK = 0.2
FAN = 256
FILTER_BITS = 1 << 25
MANY = 200_000  # a key that so many documents have is as frequent as any
FEW = 200_000  # pairs, of which each side is sent to the executors (6 MB); more are shuffled
BLOCK = 1024  # documents of a run compared at a time
SKETCH_BITS = 2048


def least_size(percent: int) -> int:
    """The smallest set that can link with a different one."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


@lru_cache(maxsize=65536)
def spaces(size: int, percent: int) -> tuple[tuple[int, int, int], ...]:
    """(space, sections, slack) in which a set of this size is keyed: that of its own size band,
    and that of a lower band if a partner may lie there.  Two sets that link meet in the space
    of the smaller one."""
    low, k, out = least_size(percent), 0, []
    while size >= low:
        high = max(low + 1, math.ceil(low * BAND_RATIO))
        reach = 100 * (high - 1) // percent  # the largest partner of a set of this band
        if size < high or size <= reach:
            differing = (high - 1 + reach) * (100 - percent) // (100 + percent)
            slack = math.ceil(SLACK * differing) + 1
            out.append((k, differing + 1 + slack, slack))
        low, k = high, k + 1
    return tuple(out)


def keys(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The section keys of a set, and for each how many keys of its space may be left out.

    The two lowest bits of a key tell the spaces of a set apart.  Empty
    sections have keys like the others: two sets may agree in little else.
    """
    out, drop = [], []
    for space, sections, slack in spaces(len(tokens), percent):
        spread = mix(tokens + U(space + 1))
        spot = np.sort(((((spread >> U(32)) * U(sections)) >> U(32)) << U(20)) | (spread & U((1 << 20) - 1)))
        section = spot >> U(20)
        first = np.flatnonzero(np.concatenate(([True], section[1:] != section[:-1])))
        flips, at = np.bitwise_xor.reduceat(mix(spot), first), section[first]
        flips, at = np.concatenate((flips, np.zeros(sections - len(first), U))), np.concatenate((at, np.setdiff1d(np.arange(sections, dtype=U), at)))
        out.append((mix(flips ^ mix((U(space) << U(32)) + at)) & ~U(3)) | U(space & 3))
        drop.append(np.full(len(at), slack, np.int32))
    return (np.concatenate(out), np.concatenate(drop)) if out else (np.zeros(0, U), np.zeros(0, np.int32))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test on two sorted sets of distinct hashes."""
    both = np.concatenate((a, b))
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(both) - common)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


@dataclass(frozen=True)
class Shingles:
    """How the texts of a job become sets of hashes."""

    size: int
    base: int

    def of(self, text: str | None) -> np.ndarray:
        return shingles(hashed_words(text, self.base), self.size)


def describe(docs: DataFrame, cut: Shingles, text_col: str, id_col: str) -> DataFrame:
    """``doc, n, fp1, fp2``: set size and fingerprint of every document."""

    def run(batches):
        for batch in batches:
            n, fp = [], []
            for text in batch.column(1).to_pylist():
                s = cut.of(text)
                n.append(len(s))
                fp.append((np.bitwise_xor.reduce(mix(s)) if len(s) else U(0), np.add.reduce(mix(s + U(77))) if len(s) else U(0)))
            fp = np.array(fp, U).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), as_long(fp[:, 0].copy()), as_long(fp[:, 1].copy())], names=["doc", "n", "fp1", "fp2"])

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc long, n long, fp1 long, fp2 long")


def keyed(docs: DataFrame, cut: Shingles, percent: int, text_col: str, id_col: str) -> DataFrame:
    """``key, doc, spare``: the section keys.  A set seen before in the same task emits nothing
    again: its first document stands for it (equal sets are one class anyway)."""
    names = ["key", "doc", "spare"]

    def run(batches):
        seen: set = set()
        for batch in batches:
            out, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = cut.of(text)
                if doc is None or len(s) < least_size(percent):
                    continue
                mark = np.array((np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s + U(77))))).tobytes()
                if mark in seen:
                    continue
                if len(seen) >= 50_000:
                    seen.clear()
                seen.add(mark)
                k, spare = keys(s, percent)
                out.append((k.view(np.int64), np.full(len(k), doc, np.int64), spare))
                held += len(k)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "key long, doc long, spare int")


def shared_keys(keys_: DataFrame) -> DataFrame:
    """The rows of keys that several documents have, with their number ``g``, or ``MANY`` from there on."""
    def run(batches):
        # rows of one key follow each other; ``held`` has those of the last one, which may go on
        held, size, hot = [], 0, None
        for batch in batches:
            now = [batch.column(k).to_numpy() for k in range(3)]
            if hot is not None:  # a key of which MANY rows have gone out
                more = int(np.searchsorted(now[0] != hot, True))
                if more:
                    yield rows(*(c[:more] for c in now), np.full(more, MANY))
                    now = [c[more:] for c in now]
                if not len(now[0]):
                    continue
                hot = None
            if not len(now[0]):
                continue
            more_of_it = size and held[0][0][0] == now[0][0] == now[0][-1]
            held.append(now)
            size += len(now[0])
            if more_of_it and size < MANY:
                continue
            key, doc, spare = (np.concatenate(c) for c in zip(*held, strict=True))
            ends = np.flatnonzero(key[1:] != key[:-1])
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut:
                yield from several(key[:cut], doc[:cut], spare[:cut])
            held, size = [[key[cut:], doc[cut:], spare[cut:]]], len(key) - cut
            if size >= MANY:
                hot = int(key[-1])
                yield rows(*held[0], np.full(size, MANY))
                held, size = [], 0
        if size:
            yield from several(*(np.concatenate(c) for c in zip(*held, strict=True)))

    def rows(key, doc, spare, g):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(spare), pa.array(g, pa.int64())], names=["key", "doc", "spare", "g"])

    def several(key, doc, spare):
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        length = np.diff(np.append(begin, len(key)))
        g = np.repeat(length, length)
        many = g > 1
        if many.any():
            yield rows(key[many], doc[many], spare[many], np.minimum(g[many], MANY))

    n = int(keys_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys_.repartition(n, "key").sortWithinPartitions("key").mapInArrow(tidy(run), "key long, doc long, spare int, g long")


def rare_keys(shared: DataFrame, same: DataFrame) -> DataFrame:
    """``key, doc``: what remains after each document left out its most frequent keys, with
    one document for each class of equal sets."""
    order = W.partitionBy("doc", F.col("key").bitwiseAND(F.lit(3))).orderBy(F.desc("g"), "key")
    kept = shared.withColumn("place", F.row_number().over(order)).filter("place > spare").select("key", "doc")
    return kept.join(same.select(F.col("b").alias("doc"), F.col("a").alias("rep")), "doc", "left").select("key", F.coalesce("rep", "doc").alias("doc")).distinct()


def runs_of(rare: DataFrame) -> DataFrame:
    """``key, doc, g, root``: the documents of each key that several have, with their number and the
    smallest.  Of keys with the same documents (as many, the same smallest, and the same 64-bit parity
    of their hashes) one is enough."""
    sizes = rare.groupBy("key").agg(F.count("*").alias("g"), F.min("doc").alias("root"), F.bit_xor(F.xxhash64("doc")).alias("mark")).filter("g > 1")
    return rare.join(sizes.groupBy("g", "root", "mark").agg(F.min("key").alias("key")).select("key", "g", "root"), "key")


def first_pairs(runs: DataFrame) -> DataFrame:
    """``a, b``: one partner for each document of a run, the smallest.  Long runs are dealt into parts
    of about ``FAN`` by a hash of the document, each around its smallest, which goes to the smallest
    of all.  Minima are aggregated before the shuffle and joined, so a long run can be split."""
    part = F.pmod(F.xxhash64("doc"), F.expr(f"shiftleft(1L, cast(ceil(log2(g / {FAN}.0)) as int))"))
    long_ = runs.filter(F.col("g") > FAN).withColumn("part", part)
    hubs = long_.groupBy("key", "part").agg(F.min("doc").alias("hub"))
    dealt = long_.join(hubs, ["key", "part"]).select(F.when(F.col("doc") == F.col("hub"), F.col("root")).otherwise(F.col("hub")).alias("a"), F.col("doc").alias("b"))
    found = runs.filter(F.col("g") <= FAN).select(F.col("root").alias("a"), F.col("doc").alias("b")).unionByName(dealt)
    return found.filter("a <> b").groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def bitmap(ids: DataFrame) -> np.ndarray:
    """A bit map of fixed size of hashed ids (``FILTER_BITS`` bits, whatever the input)."""
    spot = F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))
    got = ids.select(spot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[got["w"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).astype(np.uint32)
    return out


def sets_of(docs: DataFrame, ids: DataFrame, cut: Shingles, text_col: str, id_col: str) -> DataFrame:
    """``doc, n, tokens``: shingle sets of the documents named in ``ids`` (a few others may come
    along; the joins that follow drop them)."""
    mine = docs.sparkSession.sparkContext.broadcast(bitmap(ids))

    def run(batches):
        bits = mine.value
        for batch in batches:
            spot = batch.column(2).to_numpy()
            wanted = np.flatnonzero((bits[spot >> 5] >> (spot & 31).astype(np.uint32)) & np.uint32(1))
            for at in range(0, len(wanted), 200):
                part = batch.take(pa.array(wanted[at : at + 200]))
                sets = [cut.of(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc", "n", "tokens"])

    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    return rows.withColumn("spot", F.pmod(F.xxhash64("doc"), F.lit(FILTER_BITS))).mapInArrow(tidy(run), "doc long, n long, tokens binary")


def verified(docs: DataFrame, pairs: DataFrame, sizes: DataFrame, cut: Shingles, percent: int, text_col: str, id_col: str) -> DataFrame:
    """``a, b``: the pairs (columns a, b) that link.  Each member's set goes once to the
    document that it is compared with."""
    fit = pairs.join(sizes.select(F.col("doc").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb")), "b")
    fit = written(fit.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct(), "pairs")
    few = fit.count() <= FEW
    want = fit.select(F.col("b").alias("doc"), F.col("a").alias("hub")).unionByName(fit.select(F.col("a").alias("doc"), F.col("a").alias("hub")).distinct())
    rows = sets_of(docs, want.select("doc").distinct(), cut, text_col, id_col).join(F.broadcast(want) if few else want, "doc")

    def run(batches):
        hub, own = None, []
        for batch in batches:
            a, b = [], []
            for h, d, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                tokens = np.frombuffer(data.as_buffer(), U)
                if h != hub:
                    hub, own = h, []
                if d == h:
                    own.append(tokens.copy())
                elif any(linked(x, tokens, percent) for x in own):
                    a.append(h)
                    b.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("hub", "doc", "tokens").repartition(n, "hub").sortWithinPartitions("hub", F.col("doc") != F.col("hub"))
    found = written(dealt.mapInArrow(tidy(run), "a long, b long"), "links")
    dropped(fit)
    return found


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes over ``SKETCH_BITS`` bits."""
    odd = np.bincount((mix(tokens + U(99)) % U(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(U)


def sketches_of(docs: DataFrame, ids: DataFrame, cut: Shingles, text_col: str, id_col: str) -> DataFrame:
    """``doc, n, sketch`` of the documents named in ``ids``."""

    def run(batches):
        for batch in batches:
            made = [sketch(np.frombuffer(t.as_buffer(), U)).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], names=["doc", "n", "sketch"])

    return sets_of(docs, ids, cut, text_col, id_col).mapInArrow(tidy(run), "doc long, n long, sketch binary")


def open_rows(runs: DataFrame, roots: DataFrame) -> DataFrame:
    """``key, doc, root`` of the runs whose documents are in several components."""
    rows = runs.select("key", "doc").join(roots.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
    several = rows.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 < r1").select("key")
    return rows.join(several, "key").select("key", "doc", "root")


def cross_pairs(rows: DataFrame, sketches: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """``a, b``: pairs of a run in different components that sizes and sketches allow to link.

    ``nearest``: for each document of a run only the one with the least Hamming
    distance.  A run is dealt into parts of about ``BLOCK`` documents, and each
    pair of parts is compared by itself, in bounded memory.
    """

    def pairs(x, y):
        (doc, root, n, bits), (doc2, root2, n2, bits2) = x, y
        step = max(1, 2_000_000 // (len(doc2) * bits2.shape[1]))
        for at in range(0, len(doc), step):
            own = slice(at, at + step)
            apart = np.bitwise_count(bits[own, None] ^ bits2[None]).sum(axis=2, dtype=np.int64)
            low, high = np.minimum(n[own, None], n2), np.maximum(n[own, None], n2)
            fit = (root[own, None] != root2) & (100 * low >= percent * high) & (apart * (100 + percent) <= (100 - percent) * (low + high))
            if nearest:
                some = np.flatnonzero(fit.any(axis=1))
                other = np.where(fit[some], apart[some], 1 << 40).argmin(axis=1)
                yield doc[own][some], doc2[other], apart[some, other]
            else:
                i, j = np.nonzero(fit & (doc[own, None] < doc2))
                yield doc[own][i], doc2[j], apart[i, j]

    def run(batches):
        held: list = []
        last = None

        def made():
            part, doc, root, n = (np.array([r[k] for r in held], np.int64) for k in range(4))
            bits = np.frombuffer(b"".join(r[4] for r in held), U).reshape(len(held), -1)
            side = lambda p: tuple(c[part == p] for c in (doc, root, n, bits))
            low, high = int(part.min()), int(part.max())
            if low == high and last[1] != last[2]:
                return
            for x, y in [(low, high)] if low == high else [(low, high), (high, low)]:
                for a, b, d in pairs(side(x), side(y)):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], names=["x", "y", "d"])

        for batch in batches:
            for *block, part, doc, root, n, bits in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
                if block != last and held:
                    yield from made()
                    held = []
                last = block
                held.append((part, doc, root, n, bits))
        if held:
            yield from made()

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    full = rows.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(sketches, "doc")
    full = full.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "doc", "root", "n", "sketch")
    found = full.repartition(count, "key", "p", "q").sortWithinPartitions("key", "p", "q", "doc").mapInArrow(tidy(run), "x long, y long, d long")
    if nearest:
        found = found.groupBy("x").agg(F.min_by("y", F.struct("d", "y")).alias("y"))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def join(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """``doc, n_shingles, component_id`` of every row: the components of the links
    ``100 * intersection >= percent * union`` between sets of ``size``-word shingles."""
    spark: SparkSession = docs.sparkSession
    small_batches(spark)
    cut = Shingles(size, drawn_base())
    known = written(describe(docs, cut, text_col, id_col), "sets")
    classes = written(known.filter("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc").alias("rep"), F.count("*").alias("k")), "classes")
    sizes = known.filter("doc is not null").select("doc", "n")
    shared = written(shared_keys(keyed(docs, cut, percent, text_col, id_col)), "shared")
    swept(spark)
    same = known.join(classes.filter("k > 1"), ["fp1", "fp2", "n"]).filter("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"))
    same = written(same.distinct(), "same")
    rare = written(rare_keys(shared, same), "rare")
    runs = written(runs_of(rare), "runs")
    for old in (classes, shared, rare):
        dropped(old)
    swept(spark)
    links = verified(docs, first_pairs(runs), sizes, cut, percent, text_col, id_col)
    roots = written(components(links.unionByName(same)), "roots")
    sketches, nearest = None, True
    while not (left := written(open_rows(runs, roots), "open")).isEmpty():
        if sketches is None:
            sketches = written(sketches_of(docs, left.select("doc").distinct(), cut, text_col, id_col), "sketches")
        more = written(cross_pairs(left, sketches, percent, nearest), "cross")
        extra = verified(docs, more, sizes, cut, percent, text_col, id_col)
        asked, gained = more.count(), extra.count()
        if gained:
            tree = roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
            before, roots = roots, written(components(tree.unionByName(extra)), "roots")
            dropped(before)
        for old in (left, more, extra):
            dropped(old)
        swept(spark)
        if not nearest:
            break
        # nearest pairs that mostly do not link have done their part: all that is left is verified once
        nearest = 2 * gained > asked
    dropped(left)
    own = known.select("doc", "n").join(roots.withColumnRenamed("node", "doc"), "doc", "left")
    out = written(own.select("doc", F.col("n").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id")), "near")
    for old in (known, same, runs, links, roots, sketches):
        if old is not None:
            dropped(old)
    return out
