"""Benchmark decontamination by spaced-seed hashing.

Fixed masks over a window of words ignore the positions marked 0, so a hash
survives substitutions there.  The masks hit every overlap that is accepted: a
changed word spoils at most four places of the first mask, and the four changes
of a stretch of 20 words never spoil just its 16 places; overlaps of 10 or 11
words, which the first may miss, have a second mask.  Hashes of the test items and of the documents are joined; around the hits of a
document with an item on one diagonal the word sequences are compared, and an
overlap counts if it spans ``overlap`` words (or the share ``rate`` of the
item, if that is shorter) of which the share ``rate`` is equal.  Items of fewer
than ``least`` words are too short for changes: they have one mask over all
their words and count only where they stand whole and unchanged.

The documents are first held against a bit map of the test hashes, whose size
is fixed; what passes is joined exactly by Spark, which broadcasts the test
side if its size allows and shuffles it otherwise.

Defined results: null and empty texts overlap with nothing; a repeated item
or document id gives one row for each pair of ids, that of the longest
overlap; ties go to the earliest place in the document, then in the item;
rows without id are left out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy, written
from .words import U, WordHash, mix

#: The first hits all stretches of 7 to 9 and of 12 words or more with at least 0.8 equal, both all of 7 or more.
MASKS = ("11011", "11001011")
LEAST = 8
SPAN = max(*map(len, MASKS), LEAST - 1)
LONG = 14
BITS = 1 << 24
WORD = re.compile(r"\w+")


def word_hashes(text: str | None, known: WordHash) -> np.ndarray:
    found = WORD.findall((text or "").lower())
    return np.fromiter(map(known.__getitem__, found), U, len(found))


#: One odd factor for each place of a window.
FACTORS = [U(x | 1) for x in mix(np.arange(1, SPAN + 1, dtype=U)).tolist()]


def windows(words: np.ndarray, masks: list[tuple[int, str]]) -> list[np.ndarray]:
    """Hash of each window under each mask, from products that the masks share."""
    products = [words[k:] * f for k, f in enumerate(FACTORS[: len(words)])]
    out = []
    for tag, mask in masks:
        n = len(words) - len(mask) + 1
        if n <= 0:
            out.append(words[:0])
            continue
        total = np.full(n, tag * 1_000_003 + 17, U)
        for k, bit in enumerate(mask):
            if bit == "1":
                total += products[k][:n]
        out.append(mix(total))
    return out


def masks_for(lengths: list[int]) -> list[tuple[int, str]]:
    """The seeds for items of such lengths: the first for those of ``LEAST`` words or more, the
    second too for those under ``LONG``, and one over all words for each shorter length."""
    out = [(0, MASKS[0])] if max(lengths, default=LONG) >= LEAST else []
    if any(LEAST <= n < LONG for n in lengths):
        out.append((1, MASKS[1]))
    return out + [(len(MASKS) + n, "1" * n) for n in sorted(set(lengths)) if 0 < n < LEAST]


def bit_map(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit map of hashed values; its size is ``bits`` whatever their number."""
    spot = F.col(column).bitwiseAND(F.lit(bits - 1))
    got = values.select(spot.alias("s")).groupBy(F.shiftright("s", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("b")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[got["w"].to_numpy(np.int64)] = got["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def has_bit(map_: np.ndarray, values: np.ndarray) -> np.ndarray:
    spot = values & U(len(map_) * 32 - 1)
    return (map_[spot >> U(5)] >> (spot & U(31)).astype(np.uint32)) & np.uint32(1) > 0


def tokens(rows: DataFrame, text_col: str, id_col: str, name: str, only: np.ndarray | None = None) -> DataFrame:
    """``name, words``: word hashes of each text, of those in the bit map ``only`` if given."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(only)

    def run(batches):
        known = WordHash()
        for batch in batches:
            take = np.arange(batch.num_rows) if shared.value is None else np.flatnonzero(has_bit(shared.value, batch.column(2).to_numpy().view(U)))
            part = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([word_hashes(t, known).tobytes() for t in part.column(1).to_pylist()], pa.binary())], names=[name, "words"])

    source = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias(name), F.col(text_col).alias("text"))
    return source.withColumn("spot", F.xxhash64(name)).mapInArrow(tidy(run), f"{name} long, words binary")


def seeds(items: DataFrame) -> tuple[DataFrame, list[int]]:
    """``hash, item, at`` of the test items, and the lengths that occur (``LONG`` for all from there on)."""

    def run(batches):
        for batch in batches:
            h, item, at, short = [], [], [], []
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                w = np.frombuffer(data.as_buffer(), U)
                if not len(w):
                    continue
                for got in windows(w, masks_for([len(w)])):
                    h.append(got)
                    item.append(np.full(len(got), i, np.int64))
                    at.append(np.arange(len(got)))
                    short.append(np.full(len(got), min(len(w), LONG)))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64), pa.int64()) for x in (h, item, at, short)], names=["hash", "item", "at", "short"])

    out = written(items.mapInArrow(tidy(run), "hash long, item long, at long, short long"), "seeds")
    return out, [r[0] for r in out.select("short").distinct().collect()]


def longest(equal: np.ndarray, rate: float) -> tuple[int, int]:
    """(start, end) of the longest stretch that starts and ends with an equal word and has at
    least the share ``rate`` of them; the first of equally long ones."""
    if not equal.any():
        return 0, 0
    run = np.concatenate(([0.0], np.cumsum(equal - rate)))
    starts = np.flatnonzero(equal)
    ends = starts + 1
    low = np.minimum.accumulate(run[starts])
    best = (0, 0)
    # the earliest start whose running sum is not above that at the end
    first = np.searchsorted(-low, -(run[ends] + 1e-9), side="left")
    for e, f in zip(ends, first, strict=True):
        if f < len(starts) and starts[f] < e and e - starts[f] > best[1] - best[0]:
            best = (int(starts[f]), int(e))
    return best


def overlaps(docs: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "doc_id", item_text: str = "text", item_id: str = "item_id", overlap: int = 20, rate: float = 0.8) -> DataFrame:
    """``doc, item, n_words, n_equal, doc_at, item_at``: one row per document and item that overlap."""
    spark = docs.sparkSession
    small_batches(spark)
    known_items = written(tokens(items, item_text, item_id, "item"), "items")
    seed, lengths = seeds(known_items)
    shared = spark.sparkContext.broadcast((bit_map(seed, "hash", BITS), masks_for(lengths)))

    def find(batches):
        known = WordHash()
        map_, masks = shared.value
        for batch in batches:
            h, doc, at = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = word_hashes(text, known)
                for got in windows(w, masks):
                    spot = np.flatnonzero(has_bit(map_, got))
                    if len(spot):
                        h.append(got[spot])
                        doc.append(np.full(len(spot), i, np.int64))
                        at.append(spot)
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64), pa.int64()) for x in (h, doc, at)], names=["hash", "doc", "place"])

    source = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    hits = written(source.mapInArrow(tidy(find), "hash long, doc long, place long"), "hits")
    diagonal = written(hits.join(seed, "hash").groupBy("doc", "item", (F.col("place") - F.col("at")).alias("shift")).agg(F.count("*").alias("n_hits")), "diagonals")
    mine = tokens(docs, text_col, id_col, "doc", bit_map(diagonal.select(F.xxhash64("doc").alias("spot")), "spot", BITS))
    pairs = diagonal.groupBy("doc", "item").agg(F.collect_set("shift").alias("shifts"))
    joined = pairs.join(mine.withColumnRenamed("words", "theirs"), "doc").join(known_items, "item")

    def verify(batches):
        for batch in batches:
            out = []
            for doc, item, shifts, theirs, own in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                d, q = np.frombuffer(theirs, U), np.frombuffer(own, U)
                best = None
                for shift in sorted(shifts):
                    lo, hi = max(0, -shift), min(len(q), len(d) - shift)
                    if hi <= lo:
                        continue
                    equal = d[lo + shift : hi + shift] == q[lo:hi]
                    s, e = longest(equal, 1.0 if len(q) < LEAST else rate)
                    if e - s >= len(q) or len(q) >= LEAST and (e - s >= min(overlap, len(q)) or (len(q) < overlap and e - s >= rate * len(q))):
                        row = (e - s, int(equal[s:e].sum()), -(lo + shift + s), -(lo + s))
                        best = max(best, row) if best else row
                if best:
                    out.append((doc, item, best[0], best[1], -best[2], -best[3]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc", "item", "n_words", "n_equal", "doc_at", "item_at"])

    found = joined.select("doc", "item", "shifts", "theirs", "words").mapInArrow(tidy(verify), "doc long, item long, n_words long, n_equal long, doc_at long, item_at long")
    best = F.max(F.struct("n_words", "n_equal", (-F.col("doc_at")).alias("doc_at"), (-F.col("item_at")).alias("item_at"))).alias("b")
    return found.groupBy("doc", "item").agg(best).select("doc", "item", "b.n_words", "b.n_equal", (-F.col("b.doc_at")).alias("doc_at"), (-F.col("b.item_at")).alias("item_at"))
