"""Suffix-array dedup: bytes that a long repeated string covers.

Distribution: every string of ``length`` bytes has a smallest k-gram hash, its
anchor; equal strings have equal anchors.  Runs of starts with one anchor make
a context, the bytes all their strings cover.  Contexts that occur twice are
repeated as a whole; anchors that only one context has repeat nothing.  What
is left, the different contexts of shared anchors, is dealt out by anchor.

In each share a suffix array is built by the difference-cover algorithm: the
suffixes at places 1 and 2 modulo 3 are sorted by their triples, named,
sorted by recursion on the names while these are not unique, the others are
sorted by their first byte and the rank behind it and merged in; then
neighbours in the array are compared over ``length`` bytes.  The recursion
may stop once names cover ``length`` bytes.

An anchor with more than ``HOT`` different contexts (a line that many texts
hold) is not sorted in one task.  Of its contexts only those go on that agree
with another one around the anchor in nearly ``length`` bytes: a string that
two contexts share reaches some way to the left of the anchor and the rest to
the right, so in one of ``CUTS`` splits both have the same bytes on both
sides.  If all bytes that the strings of a split cover stand around another
context's anchor too, all these strings are repeated, and one of the contexts
names them for all; other strings are named too, by a 128-bit hash, and counted
by Spark, split by name.

Contexts and texts are known by 128-bit XXH3 and by SHA-256 of their bytes.

Defined results: null is the empty text; nothing is removed from texts
shorter than ``length``, and matches never cross texts; strings that overlap
themselves count; repeated rows and equal texts are removed in all copies; an
empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import dropped, small_batches, swept, tidy, written
from .words import U, Powers, mix

GRAM = 32
SEGMENT = 1 << 20
SHARE = 1 << 20  # bytes for a suffix array, unless one anchor has more
BITS = 1 << 26
HOT = 2048  # different contexts of an anchor: more than a share
CUTS = 8
FEW = 100_000  # frequent anchors that may be broadcast (some 5 MB)


def order_by(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each key differs from the one before in that order), first key most significant."""
    wide = [max(1, int(k.max()).bit_length()) if len(k) else 1 for k in keys]
    if sum(wide) <= 63:
        packed = keys[0].astype(np.int64)
        for k, w in zip(keys[1:], wide[1:], strict=True):
            packed = (packed << w) | k
        room = max(1, len(packed).bit_length())
        if sum(wide) + room <= 63:  # the places fit in too, so values are sorted, which is faster
            packed = (packed << room) | np.arange(len(packed))
            packed.sort()
            order, packed = packed & ((1 << room) - 1), packed >> room
        else:
            order = np.argsort(packed)
            packed = packed[order]
        return order, np.concatenate(([True], packed[1:] != packed[:-1]))
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    new[:1] = True
    return order, new


def below(mine: tuple[np.ndarray, ...], sorted_: tuple[np.ndarray, ...]) -> np.ndarray:
    """How many of the sorted keys are below each of ``mine``."""
    wide = [max(1, int(max(a.max(initial=0), b.max(initial=0))).bit_length()) for a, b in zip(mine, sorted_, strict=True)]
    if sum(wide) <= 63:
        pack = lambda ks: sum((k.astype(np.int64) << sum(wide[i + 1 :]) for i, k in enumerate(ks)), np.int64(0))
        return np.searchsorted(pack(sorted_), pack(mine))
    both = tuple(np.concatenate((a, b)) for a, b in zip(mine, sorted_, strict=True))
    order = np.lexsort((np.arange(len(both[0])), *both[::-1]))  # of equals, mine come first
    other = order >= len(mine[0])
    out = np.empty(len(mine[0]), np.int64)
    out[order[~other]] = np.cumsum(other)[~other]
    return out


def suffix_array(s: np.ndarray, depth: int | None = None, covers: int = 1) -> np.ndarray:
    """Suffix array of a string of integers from 1 by the difference cover {1, 2} modulo 3.

    With ``depth`` suffixes are sorted by that many symbols at least;
    ``covers``: symbols of the first string that one symbol stands for."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s.astype(np.int64), np.zeros(3, np.int64)))
    one = np.arange(1, n + (n % 3 == 1), 3)
    two = np.arange(2, n, 3)
    sample = np.concatenate((one, two))
    order, new = order_by(t[sample], t[sample + 1], t[sample + 2])
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(new)
    if not new.all() and (depth is None or 3 * covers < depth):
        order = suffix_array(names, depth, 3 * covers)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(order) + 1)
    sample = sample[order]
    zero = np.arange(0, n, 3)
    zero = zero[order_by(t[zero], rank[zero + 1])[0]]
    sample = sample[sample < n]
    first, second = sample[sample % 3 == 1], sample[sample % 3 == 2]
    place = np.arange(len(zero)) + below((t[zero], rank[zero + 1]), (t[first], rank[first + 1])) + below((t[zero], t[zero + 1], rank[zero + 2]), (t[second], t[second + 1], rank[second + 2]))
    out = np.empty(n, np.int64)
    # with a bounded depth equal keys may leave places out of order; keep them increasing
    place = np.maximum.accumulate(place - np.arange(len(place))) + np.arange(len(place))
    free = np.ones(n, bool)
    free[place] = False
    out[place] = zero
    out[free] = sample
    return out


def repeated_starts(data: np.ndarray, owned: np.ndarray, length: int) -> np.ndarray:
    """Mask of the owned starts whose string of ``length`` bytes starts at another owned place too.
    ``data``: bytes; ``owned``: places from which ``length`` bytes belong together."""
    sa = suffix_array(data.astype(np.int64) + 1, length)
    sa = sa[owned[sa]]
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    word = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view(U).ravel()
    alive = np.arange(len(sa) - 1)
    for at in [*range(0, length - 7, 8), length - 8]:
        alive = alive[word[sa[alive] + at] == word[sa[alive + 1] + at]]
    out = np.zeros(len(data), bool)
    out[sa[alive]] = True
    out[sa[alive + 1]] = True
    return out


def contexts(data: np.ndarray, length: int):
    """(anchor, start, starts, place of the anchor) of each context of a text, as arrays."""
    out = []
    for base in range(0, max(0, len(data) - length + 1), SEGMENT):
        part = data[base : base + SEGMENT + length - 1]
        up, down = Powers.upto(len(part) + 1)
        run = np.zeros(len(part) + 1, U)
        np.cumsum((part.astype(U) + U(1)) * up[:-1], out=run[1:])
        grams = mix((run[GRAM:] - run[:-GRAM]) * down[: len(part) - GRAM + 1])
        width = length - GRAM + 1
        # smallest hash in each window, the leftmost of equals
        key = (grams & ~U((1 << 22) - 1)) | np.arange(len(grams), dtype=U)
        blocks = -(-len(key) // width)
        full = np.full(blocks * width, ~U(0), U)
        full[: len(key)] = key
        full = full.reshape(blocks, width)
        head = np.minimum.accumulate(full, axis=1).ravel()
        tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(part) - length + 1
        spot = (np.minimum(tail[:n], head[width - 1 : width - 1 + n]) & U((1 << 22) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], spot[1:] != spot[:-1])))
        out.append((grams[spot[start]].view(np.int64), start + base, np.diff(np.append(start, n)), spot[start] + base))
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4


def names(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(n, 2): 128-bit hashes of stretches."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]), np.int64).reshape(-1, 2)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def occurrences(texts: DataFrame, length: int) -> DataFrame:
    """``text_key, anchor, start, starts, fp1, fp2``."""
    columns = ["text_key", "anchor", "start", "starts", "fp1", "fp2"]

    def run(batches):
        for batch in batches:
            out, held = [], 0
            for text in batch.column(0).to_pylist():
                raw = as_bytes(text)
                if len(raw) >= length:
                    anchor, start, starts, _ = contexts(np.frombuffer(raw, np.uint8), length)
                    fp = names(raw, start, start + starts + (length - 1))
                    key = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(anchor), np.int32)), pa.array([hashlib.sha256(raw).digest()])).cast(pa.binary())
                    out.append([key, *map(pa.array, (anchor, start, starts, fp[:, 0].copy(), fp[:, 1].copy()))])
                    held += len(anchor)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], names=columns)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], names=columns)

    return texts.mapInArrow(tidy(run), "text_key binary, anchor long, start long, starts long, fp1 long, fp2 long")


def shared_contexts(texts: DataFrame, anchors: np.ndarray, length: int) -> DataFrame:
    """``anchor, fp1, fp2, starts, at, data``: contexts whose anchor is in the bit map (``at``: its place in them)."""
    shared = texts.sparkSession.sparkContext.broadcast(anchors)
    columns = ["anchor", "fp1", "fp2", "starts", "at", "data"]

    def run(batches):
        bits, seen = shared.value, set()
        for batch in batches:
            out, held = [], 0
            for text in batch.column(0).to_pylist():
                raw = as_bytes(text)
                if len(raw) < length:
                    continue
                anchor, start, starts, place = contexts(np.frombuffer(raw, np.uint8), length)
                spot = anchor.view(U) & U(BITS - 1)
                some = np.flatnonzero((bits[spot >> U(5)] >> (spot & U(31)).astype(np.uint32)) & np.uint32(1))
                fp = names(raw, start[some], start[some] + starts[some] + (length - 1))
                for i, own in zip(some.tolist(), fp, strict=True):
                    mark = own.tobytes()
                    if mark in seen:
                        continue
                    if len(seen) >= 50_000:
                        seen.clear()
                    seen.add(mark)
                    data = raw[start[i] : start[i] + starts[i] + length - 1]
                    out.append((int(anchor[i]), int(own[0]), int(own[1]), int(starts[i]), int(place[i] - start[i]), data))
                    held += len(data)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=columns)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=columns)

    return texts.mapInArrow(tidy(run), "anchor long, fp1 long, fp2 long, starts long, at long, data binary")


def splits(length: int) -> list[tuple[int, int, int, int]]:
    """(bytes to the left of the anchor, bytes to its right, least and first greater reach to the
    left): a string whose reach lies between the last two has at least the first two."""
    room = length - GRAM
    step = -(-(room + 1) // CUTS)
    return [(low, max(0, room - low - step + 1), low, low + step) for low in range(0, room + 1, step)]


def starts_of(cut: tuple[int, int, int, int], at: int, starts: int) -> tuple[int, int]:
    """The range of a context's starts that belong to a split."""
    return max(0, at - cut[3] + 1), min(starts, at - cut[2] + 1)


def around(found: DataFrame, length: int) -> DataFrame:
    """``fp1, fp2, cut, whole, lo, hi, k1, k2``: names of what stands around the anchors in each
    split that fits in, and (``whole``) of all bytes that the split's starts ``lo`` to ``hi`` cover."""
    cuts = splits(length)

    def run(batches):
        for batch in batches:
            out, raws, begin, end, base = [], [], [], [], 0
            for fp1, fp2, starts, at, data in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                for k, cut in enumerate(cuts):
                    lo, hi = starts_of(cut, at, starts)
                    if lo < hi and at >= cut[0] and at + GRAM + cut[1] <= len(data):
                        out += [(fp1, fp2, k, 0, lo, hi), (fp1, fp2, k, 1, lo, hi)]
                        begin += [base + at - cut[0], base + lo]
                        end += [base + at + GRAM + cut[1], base + hi - 1 + length]
                raws.append(data)
                base += len(data)
            if out:
                k = names(b"".join(raws), np.array(begin), np.array(end))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*out, strict=True)), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy())], names=["fp1", "fp2", "cut", "whole", "lo", "hi", "k1", "k2"])

    return found.select("fp1", "fp2", "starts", "at", "data").mapInArrow(tidy(run), "fp1 long, fp2 long, cut long, whole long, lo long, hi long, k1 long, k2 long")


def named_strings(found: DataFrame, length: int) -> DataFrame:
    """``fp1, fp2, lo, n1, n2``: the strings of contexts in the splits ``cuts`` (an array of numbers)."""
    cuts = splits(length)

    def run(batches):
        for batch in batches:
            for fp1, fp2, starts, at, data, mine in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                lo = np.array([s for c in sorted(mine) for s in range(*starts_of(cuts[c], at, starts))], np.int64)
                n = names(data, lo, lo + length)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lo), fp1)), pa.array(np.full(len(lo), fp2)), pa.array(lo), pa.array(n[:, 0].copy()), pa.array(n[:, 1].copy())], names=["fp1", "fp2", "lo", "n1", "n2"])

    return found.select("fp1", "fp2", "starts", "at", "data", "cuts").mapInArrow(tidy(run), "fp1 long, fp2 long, lo long, n1 long, n2 long")


def hot_repeats(found: DataFrame, length: int) -> DataFrame:
    """``fp1, fp2, lo, hi`` for the contexts of frequent anchors, dealt out by names, not by anchor."""
    found = written(found.dropDuplicates(["fp1", "fp2"]), "hot")
    key = written(around(found, length), "around")
    own = F.struct("fp1", "fp2")
    shared = key.groupBy("k1", "k2", "cut", "whole").agg(F.count("*").alias("n"), F.min(own).alias("first")).filter("n > 1")
    # of the contexts that share a whole split one names its strings for all
    speaks = ((F.col("whole") == 1) & (F.col("first") == own)).alias("speaks")
    again = key.join(shared, ["k1", "k2", "cut", "whole"]).select("fp1", "fp2", "cut", "lo", "hi", "whole", speaks)
    again = written(again.groupBy("fp1", "fp2", "cut", "lo", "hi").agg(F.max("whole").alias("whole"), F.max("speaks").alias("speaks")), "splits")
    cuts = again.filter("whole = 0 or speaks").groupBy("fp1", "fp2").agg(F.collect_set("cut").alias("cuts"))  # at most CUTS of a context
    strings = written(named_strings(found.join(cuts, ["fp1", "fp2"]), length), "strings")
    hits = strings.join(strings.groupBy("n1", "n2").agg(F.count("*").alias("n")).filter("n > 1"), ["n1", "n2"])
    run = F.col("lo") - F.row_number().over(W.partitionBy("fp1", "fp2").orderBy("lo"))  # at most ``length`` rows of a context
    single = hits.select("fp1", "fp2", "lo").distinct().withColumn("run", run).groupBy("fp1", "fp2", "run").agg(F.min("lo").alias("lo"), (F.max("lo") + 1).alias("hi"))
    out = written(again.filter("whole = 1").select("fp1", "fp2", "lo", "hi").unionByName(single.select("fp1", "fp2", "lo", "hi")), "hot-marks")
    for old in (found, key, again, strings):
        dropped(old)
    return out


def repeats(found: DataFrame, length: int) -> DataFrame:
    """``fp1, fp2, lo, hi``: ranges of repeated starts within contexts, by suffix arrays."""

    def share(rows):
        data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
        sizes = np.array([len(r[3]) for r in rows])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        owned = np.zeros(len(data), bool)
        for b, r in zip(begin, rows, strict=True):
            owned[b : b + r[2]] = True
        hit = repeated_starts(data, owned, length)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
        # ranges end with their context
        lo, hi = edge[::2], edge[1::2]
        row = np.searchsorted(begin, lo, side="right") - 1
        out = []
        for a, b, k in zip(lo, hi, row, strict=True):
            while True:
                stop = min(b, begin[k] + rows[k][2])
                if a < stop:
                    out.append((rows[k][0], rows[k][1], int(a - begin[k]), int(stop - begin[k])))
                k += 1
                if k >= len(rows) or begin[k] >= b:
                    break
                a = begin[k]
        return out

    def run(batches):
        rows, held, last = [], 0, None

        def emit(out):
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["fp1", "fp2", "lo", "hi"])

        for batch in batches:
            for anchor, fp1, fp2, starts, data in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if anchor != last:
                    if held >= SHARE:
                        yield emit(share(rows))
                        rows, held = [], 0
                    last = anchor
                elif rows and rows[-1][:2] == (fp1, fp2):
                    continue
                rows.append((fp1, fp2, starts, data))
                held += len(data)
        if rows:
            yield emit(share(rows))

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # by a hash of its own: after a join on the anchor Spark would leave a repartition by the anchor itself out, and
    # then read the join's rows map by map where it finds that one side can be broadcast after all
    return found.select("anchor", "fp1", "fp2", "starts", "data").repartition(n, F.xxhash64("anchor")).sortWithinPartitions("anchor", "fp1", "fp2").mapInArrow(tidy(run), "fp1 long, fp2 long, lo long, hi long")


def removed(docs: DataFrame, text_col: str = "text", length: int = 400) -> DataFrame:
    """``text_key, spans``: for texts with repeated strings, the ranges of their starts (SHA-256 of the UTF-8 text)."""
    from .decontaminate import bit_map

    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text_col).alias("text"))
    seen = written(occurrences(texts, length), "contexts")
    counted = written(seen.groupBy("fp1", "fp2").agg(F.count("*").alias("n"), F.min("anchor").alias("anchor"), F.max("starts").alias("starts")), "counted")
    twice = counted.filter("n > 1").select("fp1", "fp2", F.lit(0).cast("long").alias("lo"), F.col("starts").alias("hi"))
    several = written(counted.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1"), "anchors")
    found = shared_contexts(texts, bit_map(several, "anchor", BITS), length)
    hot = several.filter(F.col("k") > HOT).select("anchor")
    known = hot.count()
    if known:
        found = written(found, "shared")
        # one in ``HOT`` contexts at most, so they are few; then the contexts need no shuffle of their own to be told apart
        hot = F.broadcast(hot) if known <= FEW else hot
        marks = twice.unionByName(repeats(found.join(hot, "anchor", "left_anti"), length)).unionByName(hot_repeats(found.join(hot, "anchor", "left_semi"), length))
    else:
        marks = twice.unionByName(repeats(found, length))
    marks = written(marks.distinct(), "marks")
    swept(docs.sparkSession)
    spans = seen.join(marks, ["fp1", "fp2"]).groupBy("text_key").agg(F.collect_set(F.struct((F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi"))).alias("spans"))
    out = written(spans, "spans")
    for old in (seen, counted, several, found, marks):
        dropped(old)
    swept(docs.sparkSession)
    return out


def kept_bytes(raw: bytes, spans: list[tuple[int, int]], length: int) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs)."""
    out, at, gone, runs = [], 0, 0, 0
    for lo, hi in sorted(spans):
        end = hi - 1 + length
        if lo > at or (runs == 0 and lo == at):
            out.append(raw[at:lo])
            runs += 1
            gone += end - lo
        else:
            gone += max(0, end - at)
        at = max(at, end)
    return b"".join([*out, raw[at:]]), gone, runs


def dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = 400) -> DataFrame:
    """The id, ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (the remaining bytes) of every row."""
    from .decontaminate import bit_map, has_bit

    spans = removed(docs, text_col, length)
    kind = docs.schema[id_col].dataType.simpleString()
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(spans.select(F.xxhash64("text_key").alias("spot")), "spot", BITS))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text")).withColumn("text_key", F.unhex(F.sha2("__text", 256))).withColumn("spot", F.xxhash64("text_key"))
    out = f"`{id_col}` {kind}, n_bytes long, n_removed long, n_spans long, kept binary"

    def finished(ids: pa.Array, found: list[tuple[int, bytes, int, int]]) -> pa.RecordBatch:
        kept, removed_, runs = (pa.array([g[k] for g in found], t) for k, t in ((1, pa.binary()), (2, pa.int64()), (3, pa.int64())))
        return pa.RecordBatch.from_arrays([ids, pa.array([g[0] for g in found], pa.int64()), removed_, runs, kept], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    def parts(want: bool):
        """Rows whose text may have spans, or, as they stay, the others."""

        def run(batches):
            for batch in batches:
                mine = batch.take(pa.array(np.flatnonzero(has_bit(bits.value, batch.column(3).to_numpy().view(U)) == want)))
                if want:
                    yield mine.select([0, 1, 2])
                else:
                    raws = map(as_bytes, mine.column(1).to_pylist())
                    yield finished(mine.column(0), [(len(raw), raw, 0, 0) for raw in raws])

        return run

    def run(batches):
        for batch in batches:
            got = []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = as_bytes(text)
                got.append((len(raw), *kept_bytes(raw, [(r["lo"], r["hi"]) for r in ranges or []], length)))
            yield finished(batch.column(0), got)

    # only texts that may have spans are shuffled to meet them
    some = rows.mapInArrow(tidy(parts(True)), f"__id {kind}, __text string, text_key binary").join(spans, "text_key", "left")
    return rows.mapInArrow(tidy(parts(False)), out).unionByName(some.select("__id", "__text", "spans").mapInArrow(tidy(run), out))
