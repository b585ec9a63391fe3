"""Largest TF-IDF cosine of each instruction against a proxy corpus.

The weights are those of a vectoriser fitted on the corpus and the
instruction together, for every instruction; only terms that both share
change a proxy text's norm, so sums over them give the dot product and the
correction, and nothing is fitted per row.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import spread, written

WORDS = re.compile(r"\w{2,}")
TERM = r"([\p{L}\p{N}_]{2,})"


def ngrams(text: Column, longest: int = 3) -> Column:
    """Word n-grams of 1 to ``longest`` lower-case tokens of two characters or more."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(1))

    def of(found: Column, size: int) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(found) - (size - 1)), lambda i: F.array_join(F.slice(found, i, size), " "))
        return F.when(F.size(found) >= size, grams).otherwise(F.array().cast("array<string>"))

    # a transform over one element keeps the words from being found anew for every gram
    return F.element_at(F.transform(F.array(words), lambda found: F.concat(*[of(found, n) for n in range(1, longest + 1)])), 1)


def term_counts(df: DataFrame, key: str, text: str, to: str, longest: int = 3) -> DataFrame:
    return df.select(F.col(key).alias(to), F.explode(ngrams(F.col(text), longest)).alias("term")).groupBy(to, "term").agg(F.count("*").alias("tf"))


BITS = 24  # of a term's hash; the map of the hashes that a corpus has is of 2 MB, whatever its size
CHUNK = 200_000  # words that are counted at once


def hash_map(theirs: DataFrame) -> np.ndarray:
    """A bit for each value of the hash that a term of the corpus has."""
    hash_ = F.pmod(F.crc32(F.col("term").cast("binary")), F.lit(1 << BITS))
    bits = theirs.select(F.shiftrightunsigned(hash_, 5).alias("w"), F.expr("shiftleft(1L, cast(pmod(crc32(cast(term as binary)), 32) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    held = np.zeros(1 << (BITS - 5), np.uint32)
    for w, b in bits:
        held[w] = b
    return held


def counter(shared: Broadcast, longest: int) -> Callable:
    # not at the top of the module, so that workers need not import it
    def fits(terms: list[str]) -> np.ndarray:
        held = shared.value
        h = np.array([zlib.crc32(t.encode()) for t in terms], np.int64) & ((1 << BITS) - 1)
        return (held[h >> 5] >> (h & 31).astype(np.uint32)) & 1 == 1

    def counted(texts: list[list[str]]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """For each text the terms that the map lets through, their counts, and the sum of the squared counts of its
        other n-grams.  N-grams are numbers here, the shorter one in front and a word; only those whose own n-grams
        are let through are spelt out, since a corpus has the parts of what it has."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        words = pa.array([w for x in texts for w in x], pa.string()).dictionary_encode()
        ids, names = words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist()
        doc, vocabulary, fit = np.repeat(np.arange(len(texts)), sizes), names, fits(names)
        start, rank, rest, docs, terms, ns = np.arange(len(ids)), ids, np.zeros(len(texts)), [], [], []
        for size in range(1, longest + 1):
            if size > 1:
                start = np.flatnonzero(doc[: max(0, len(ids) - size + 1)] == doc[size - 1 :])
                coded = pa.array(rank[start] * len(vocabulary) + ids[start + size - 1]).dictionary_encode()
                now, front = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy() // max(1, len(vocabulary))
                last, back = coded.dictionary.to_numpy() % max(1, len(vocabulary)), np.zeros(len(front), np.int64)
                back[now] = rank[start + 1]
                some = np.flatnonzero(fit[front] & fit[back])
                spelt = [f"{names[i]} {vocabulary[j]}" for i, j in zip(front[some].tolist(), last[some].tolist(), strict=True)]
                names, fit, rank = dict(zip(some.tolist(), spelt, strict=True)), np.zeros(len(front), bool), np.zeros(len(ids), np.int64)
                fit[some], rank[start] = fits(spelt), now
            keys = np.sort(doc[start] * len(fit) + rank[start])
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            n, at, which = np.diff(first, append=len(keys)), keys[first] // max(1, len(fit)), keys[first] % max(1, len(fit))
            known = fit[which]
            rest += np.bincount(at[~known], weights=n[~known].astype(float) ** 2, minlength=len(texts))
            docs.append(at[known])
            terms += [names[i] for i in which[known].tolist()]
            ns.append(n[known])
        docs = np.concatenate(docs)
        order = np.argsort(docs, kind="stable")
        ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=len(texts))))).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.array(terms, pa.string()).take(pa.array(order))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ns)[order].astype(np.int64))), pa.array(rest)

    return counted


def known_lists(df: DataFrame, key: str, text: str, theirs: DataFrame, longest: int) -> DataFrame:
    """``a, terms, tas, rest``: a row for each text with the n-grams that the corpus may have, counted where the
    text is read, and the sum of the squared counts of its other n-grams.  What the map of hashes lets through
    wrongly stays a term of its own, so nothing is lost or changed."""
    counted = counter(df.sparkSession.sparkContext.broadcast(hash_map(theirs)), longest)

    def run(batches):
        for batch in batches:
            first, size, texts = 0, 0, []
            for i, (value, words) in enumerate(zip(batch.column(1), batch.column(2), strict=True), 1):
                texts.append(words.as_py() if words.is_valid else WORDS.findall(value.as_py()))
                size += len(texts[-1])
                if size >= CHUNK or i == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i - first), *counted(texts)], names=["a", "terms", "tas", "rest"])
                    first, size, texts = i, 0, []

    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    # Python may know letters that Java does not; texts with characters that Java has not assigned are cut by Java, as the corpus is
    odd = (F.octet_length("t") > F.length("t")) & F.col("t").rlike(r"\p{Cn}")
    rows = df.select(F.col(key).alias("a"), lower.alias("t")).withColumn("words", F.when(odd, F.regexp_extract_all("t", F.lit(TERM), F.lit(1))))
    return rows.mapInArrow(run, f"a {df.schema[key].dataType.simpleString()}, terms array<string>, tas array<long>, rest double")


def known_counts(df: DataFrame, key: str, text: str, theirs: DataFrame, longest: int) -> DataFrame:
    """``a, term, ta, rest``: :func:`known_lists` with a row for each term."""
    return known_lists(df, key, text, theirs, longest).select("a", F.explode(F.arrays_zip("terms", "tas")).alias("x"), "rest").select("a", F.col("x.terms").alias("term"), F.col("x.tas").alias("ta"), "rest")


TERMS = 200_000  # terms of a corpus that is sent to the executors
HOT = 256  # texts of a corpus that share a term, beyond which it makes no pairs
BLOCK = 2_000  # texts of a corpus that are met together
WIDE = 500  # terms of a text of a block, beyond which it counts as several
PART = 500_000  # terms of the texts that meet a block in one task
DENSE = 16  # pairs for each block of the corpus, beyond which a text meets the blocks at once,
PACKED = 4  # if it has at most so many terms for each of these pairs, since its terms go to every block
SPOTS = 1_000_000  # sums, and about as many postings, that are held at once


def against_small(instructions: DataFrame, terms: list, n: float, key: str, text: str, longest: int) -> DataFrame:
    """:func:`max_similarity` against a corpus of a checked size: its postings are broadcast and each
    text is scored whole where it is read, without a shuffle."""
    at = {t: i for i, t in enumerate(sorted({r["term"] for r in terms}))}
    term = np.array([at[r["term"]] for r in terms], np.int64)
    order = np.argsort(term, kind="stable")
    names = {b: i for i, b in enumerate(dict.fromkeys(r["b"] for r in terms))}
    proxy = np.array([names[r["b"]] for r in terms], np.int64)[order]
    tf = np.array([r["tf"] for r in terms], float)[order]
    df = np.bincount(term, minlength=len(at))
    first = np.concatenate(([0], np.cumsum(df)))
    i0, i1, none = np.log(n / (1.0 + df)) + 1.0, np.log(n / (2.0 + df)) + 1.0, np.log(n / 2.0) + 1.0
    norm_b = np.bincount(proxy, weights=(tf * i0[term[order]]) ** 2, minlength=len(names))
    shared = instructions.sparkSession.sparkContext.broadcast((at, first, proxy, tf, i0, i1, norm_b))

    def best(value: str | None) -> float:
        at, first, proxy, tf, i0, i1, norm_b = shared.value
        words = WORDS.findall((value or "").lower())
        counts = Counter(words)
        for size in range(2, longest + 1):
            counts.update(map(" ".join, zip(*(words[k:] for k in range(size)), strict=False)))
        known = [(at[t], c) for t, c in counts.items() if t in at]
        if not known:
            return 0.0
        t, c = np.array(known, np.int64).T
        own = float((c * i1[t]) ** 2 @ np.ones(len(t))) + none**2 * float(sum(x * x for x in counts.values()) - (c * c).sum())
        size = first[t + 1] - first[t]
        ends = np.cumsum(size)
        spot = np.arange(ends[-1]) + np.repeat(first[t] - ends + size, size)
        w1, w0 = np.repeat(i1[t] ** 2, size), np.repeat(i0[t] ** 2, size)
        dot = np.bincount(proxy[spot], weights=np.repeat(c, size) * tf[spot] * w1, minlength=len(norm_b))
        fix = np.bincount(proxy[spot], weights=tf[spot] ** 2 * (w1 - w0), minlength=len(norm_b))
        return float((dot / np.sqrt(own * (norm_b + fix))).max())

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([best(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["k", "similarity"])

    kind = instructions.schema[key].dataType.simpleString()
    return instructions.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, similarity double").withColumnRenamed("k", key)


def weighted_corpus(theirs: DataFrame, n: float) -> DataFrame:
    """Postings ``term, b, tf, df, i0, i1, w, nb``: weights with (``i1``) and without (``i0``) the
    instruction counted, ``w`` that of the text's unit vector by ``i1``, ``nb`` its squared norm by ``i0``."""
    idf = lambda more: F.log(F.lit(n) / (more + F.col("df"))) + 1.0
    df = theirs.groupBy("term").agg(F.count("*").alias("df"))
    rows = theirs.join(df, "term").withColumn("i0", idf(F.lit(1.0))).withColumn("i1", idf(F.lit(2.0)))
    norms = rows.groupBy("b").agg(F.sum(F.pow(F.col("tf") * F.col("i0"), 2)).alias("nb"), F.sum(F.pow(F.col("tf") * F.col("i1"), 2)).alias("n1"))
    return rows.join(norms, "b").select("term", "b", "tf", "df", "i0", "i1", (F.col("tf") * F.col("i1") / F.sqrt("n1")).alias("w"), "nb")


def cosine(dot: str, fix: str) -> Column:
    return F.col(dot) / F.sqrt(F.col("na") * (F.col("nb") + F.col(fix)))


def sums(join: DataFrame) -> DataFrame:
    """``a, b`` with the dot product and the change of the norm over the terms of a join."""
    return join.groupBy("a", "b").agg(F.sum(F.col("ta") * F.col("tf") * F.pow("i1", F.lit(2))).alias("dot"), F.sum(F.pow("tf", F.lit(2)) * (F.pow("i1", F.lit(2)) - F.pow("i0", F.lit(2)))).alias("fix"), F.sum(F.col("q") * F.col("w")).alias("near"), F.first("nb").alias("nb"))


def numbered_corpus(theirs: DataFrame, n: float) -> tuple[DataFrame, DataFrame]:
    """The corpus's terms ``term, t, df, i1, top`` and its postings, with terms and texts as numbers and each
    text's block.

    Texts with the same heaviest term and a like weight of it share blocks of about ``BLOCK``; groups of fewer
    texts share blocks with others.  A text of many terms counts as several.
    """
    post = written(weighted_corpus(theirs, n), "weights")
    top = post.groupBy("term").agg(F.first("df").alias("df"), F.first("i1").alias("i1"), F.max("w").alias("top"))
    top = written(top.withColumn("t", F.monotonically_increasing_id()), "vocabulary")
    kind = post.groupBy("b").agg(F.max_by("term", F.struct("w", "term")).alias("lead"), F.floor(8 * F.max("w")).alias("level"), F.greatest(F.lit(1.0), F.count("*") / WIDE).alias("size"))
    kind = written(kind.withColumn("id", F.monotonically_increasing_id()), "kinds")
    parts = kind.groupBy("lead", "level").agg(F.sum("size").alias("size")).withColumn("parts", F.ceil(F.col("size") / BLOCK))
    few = F.col("size") < BLOCK
    bins = math.ceil((parts.filter(few).agg(F.sum("size")).first()[0] or 0) / BLOCK)
    own = F.concat_ws(":", F.col("level").cast("string"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("string"), "lead")
    block = F.when(few, F.concat(F.lit("few:"), F.pmod(F.xxhash64("lead", "level"), F.lit(max(1, bins))).cast("string"))).otherwise(own)
    places = kind.drop("size").join(parts, ["lead", "level"]).select("b", "id", block.alias("block"))
    return top, written(post.join(top.select("term", "t"), "term").join(places, "b").select("t", F.col("id").alias("b"), "block", "tf", "df", "i0", "i1", "w", "nb"), "postings")


def against_large(mine: DataFrame, theirs: DataFrame, n: float, hot: int) -> DataFrame:
    """``a, s``: the largest cosine of each text ``a`` of :func:`known_lists` with a shared term.

    Only terms of at most ``hot`` corpus texts make pairs.  What the frequent
    terms can add to a pair is bounded for each text by their largest weights
    and by their length in its unit vector, so few pairs have to look them up,
    by text and term.  Corpus texts that share frequent terms alone matter
    where that bound beats the best pair; they are met in blocks, those left
    out whose own largest weights cannot beat it either.  A text that would
    make more pairs than its terms sent to every block cost meets all blocks
    instead.
    """
    top, post = numbered_corpus(theirs, n)
    none = float(np.log(n / 2.0) + 1.0)
    seen = mine.select("a", "rest", F.explode(F.arrays_zip("terms", "tas")).alias("x")).select("a", "rest", F.col("x.terms").alias("term"), F.col("x.tas").alias("ta")).join(top, "term", "left")
    x, often, all_ = F.col("ta") * F.coalesce("i1", F.lit(none)), F.col("df") > hot, lambda c: F.sum(F.when(often, c).otherwise(0.0))
    texts = seen.groupBy("a").agg(
        (F.sum(x * x) + F.first("rest") * none**2).alias("na"), F.least(all_(x * F.col("top")), F.sqrt(all_(x * x))).alias("more"),
        F.sum(F.when(F.col("df") <= hot, F.col("df")).otherwise(0)).alias("pairs"), F.collect_list(F.when(F.col("t").isNotNull(), F.struct("t", "ta", often.alias("often")))).alias("terms"),
    )
    texts = written(texts.filter(F.size("terms") > 0).withColumn("more", F.col("more") / F.sqrt("na")), "texts")
    blocks = post.select("block").distinct()
    dense = F.col("pairs") > blocks.count() * F.greatest(F.lit(DENSE), F.size("terms") / PACKED)
    at_once = met(texts.filter(dense).crossJoin(F.broadcast(blocks)), post)

    texts = texts.filter(~dense)
    seen = texts.select("a", "na", F.explode("terms").alias("x")).select("a", "x.t", "x.ta", "na")
    rare_post, frequent_post = post.filter(F.col("df") <= hot).drop("df", "block"), post.filter(F.col("df") > hot).drop("df", "block")
    weighed = lambda join: join.withColumn("q", F.col("ta") * F.col("i1") / F.sqrt("na")).drop("na")
    pairs = written(sums(weighed(seen.join(rare_post, "t"))).join(texts.select("a", "na", "more"), "a").withColumn("least", cosine("dot", "fix")), "pairs")
    floor_ = pairs.groupBy("a").agg(F.max("least").alias("floor"))
    # the largest of equals stays too: rounding may not decide
    live = pairs.join(floor_, "a").filter(F.col("near") + F.col("more") >= F.col("floor") * (1 - 1e-9))
    looked = live.select("a", "b").join(seen, "a").join(frequent_post, ["b", "t"])
    added = sums(weighed(looked)).select("a", "b", F.col("dot").alias("dot1"), F.col("fix").alias("fix1"))
    exact = live.join(added, ["a", "b"], "left").withColumn("dot", F.col("dot") + F.coalesce("dot1", F.lit(0.0))).withColumn("fix", F.col("fix") + F.coalesce("fix1", F.lit(0.0)))
    best = written(exact.groupBy("a").agg(F.max(cosine("dot", "fix")).alias("s")), "best")

    texts = texts.withColumn("terms", F.filter("terms", lambda x: x.often))
    open_ = texts.join(best, "a", "left").withColumn("s", F.coalesce("s", F.lit(0.0))).filter(F.col("more") > F.col("s"))
    meets = written(promising(open_, post.filter(F.col("df") > hot)), "meets")
    return best.unionByName(at_once).unionByName(met(meets.join(texts, "a"), post.filter(F.col("df") > hot))).groupBy("a").agg(F.max("s").alias("s"))


def promising(open_: DataFrame, post: DataFrame) -> DataFrame:
    """``a, block``: the blocks whose largest weights let a text exceed its ``s``, by the given postings alone."""
    most = post.groupBy("block", "t").agg(F.max("w").alias("most"), F.first("i1").alias("i1"))
    mine = open_.select("a", "na", "s", F.explode("terms").alias("x")).select("a", "na", "s", "x.t", "x.ta")
    bound = F.sum(F.col("ta") * F.col("i1") / F.sqrt("na") * F.col("most"))
    return mine.join(most, "t").groupBy("a", "block").agg(bound.alias("bound"), F.first("s").alias("s")).filter(F.col("bound") > F.col("s")).select("a", "block")


def met(meets: DataFrame, post: DataFrame) -> DataFrame:
    """``a, s``: the largest cosine of each text over the corpus texts of a block that it meets, by the given
    postings; in one task about ``PART`` terms of texts meet a block."""
    sizes = written(meets.groupBy("block").agg(F.ceil(F.sum(F.size("terms")) / PART).alias("parts")), "sizes")
    right = post.join(sizes, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).select(F.col("block").alias("in_block"), F.col("part").alias("in_part"), "t", "b", "tf", "i0", "i1", "nb")
    left = meets.join(sizes, "block").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).select("block", "part", "a", "na", F.col("terms.t").alias("ts"), F.col("terms.ta").alias("tas"))

    def scored(texts: pa.Table, held: pa.Table) -> pa.Table:
        """The largest cosine of each text over the corpus texts whose postings are given."""
        t, b, tf, i0, i1 = (held[c].to_numpy() for c in ("t", "b", "tf", "i0", "i1"))
        order = np.argsort(t, kind="stable")
        names, b = np.unique(b, return_inverse=True)
        nb = np.zeros(len(names))
        nb[b] = held["nb"].to_numpy()
        dots, fixes, b = (tf * i1**2)[order], (tf.astype(float) ** 2 * (i1**2 - i0**2))[order], b[order]
        at, first = np.unique(t[order], return_index=True)
        n = np.diff(first, append=len(b))
        lists, counts = texts["ts"].combine_chunks(), texts["tas"].combine_chunks()
        lengths = lists.value_lengths().to_numpy().astype(np.int64)
        doc, mine, ta = np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(), counts.flatten().to_numpy()
        spot = np.minimum(np.searchsorted(at, mine), max(0, len(at) - 1))
        known = np.flatnonzero(at[spot] == mine) if len(at) else np.zeros(0, np.int64)
        doc, spot, ta = doc[known], spot[known], ta[known]
        begins = np.searchsorted(doc, np.arange(len(lengths) + 1))  # of a text's known terms
        posts = np.concatenate(([0], np.cumsum(n[spot])))[begins]  # postings in front of a text
        na, out, i = texts["na"].to_numpy(), np.zeros(len(lengths)), 0
        while i < len(lengths) and len(names):
            j = max(i + 1, min(i + SPOTS // len(names), int(np.searchsorted(posts, posts[i] + SPOTS, "right")) - 1))
            some, size = slice(begins[i], begins[j]), n[spot[begins[i] : begins[j]]]
            ends = np.cumsum(size)
            k = np.arange(size.sum()) + np.repeat(first[spot[some]] - ends + size, size)
            cell = np.repeat(doc[some] - i, size) * len(names) + b[k]
            dot = np.bincount(cell, weights=np.repeat(ta[some], size) * dots[k], minlength=(j - i) * len(names)).reshape(j - i, len(names))
            fix = np.bincount(cell, weights=fixes[k], minlength=(j - i) * len(names)).reshape(j - i, len(names))
            out[i:j] = (dot / np.sqrt(na[i:j, None] * (nb + fix))).max(1, initial=0.0)
            i = j
        return pa.table({"a": texts["a"], "s": pa.array(out)})

    return left.groupBy("block", "part").cogroup(right.groupBy("in_block", "in_part")).applyInArrow(scored, "a long, s double")


def max_similarity(instructions: DataFrame, proxies: DataFrame, key: str, text: str, proxy_key: str, proxy_text: str, longest: int = 3, terms: int = TERMS, hot: int = HOT) -> DataFrame:
    """``key, similarity`` for every instruction; 0 without tokens, without corpus or without a shared term.

    A corpus of at most ``terms`` different terms of texts is sent to the
    executors, a larger one is joined (:func:`against_large`).  Proxy rows of
    one key are one text.
    """
    n = proxies.count() + 2.0  # corpus, instruction and one for smoothing
    theirs = term_counts(proxies, proxy_key, proxy_text, "b", longest)
    if theirs.limit(terms + 1).count() <= terms:
        return against_small(instructions, theirs.collect(), n, key, text, longest)
    theirs = written(theirs.select(F.coalesce(F.concat(F.lit("="), F.col("b").cast("string")), F.lit("")).alias("b"), "term", "tf"), "corpus")
    rows = spread(instructions.select(F.struct(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key")).alias("k"), F.col(text).cast("string").alias("t")))
    mine = written(known_lists(rows, "k", "t", theirs, longest).select(F.col("a.id").alias("a"), F.col("a.key").alias("key"), "terms", "tas", "rest"), "counts")
    found = against_large(mine.drop("key"), theirs, n, hot)
    return mine.select("a", "key").join(found, "a", "left").select(F.col("key").alias(key), F.coalesce("s", F.lit(0.0)).alias("similarity"))
