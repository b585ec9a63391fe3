"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled texts is indexed; the terms of the space are all
words of the sample, their document frequencies are counted over all
documents.  (A word that no example holds would shorten all cosines of a text
alike; it is not in the space.)  The inverted index keeps, per term and block
of examples, the largest weight; blocks are scored in the order of their upper
bounds until no block left can hold one of the ``k`` nearest, or, where a
term has few postings in a block, all at once; so the result is that of the
full scan.  Neighbours vote with their cosine.  A second vote, the cue, is that
of the nearest by the ``terms`` words most associated with the label alone
(chi-squared on the sample): few labelled words weigh little among all words
of a long text.  Both votes are calibrated by a logistic fit on the examples
themselves, each scored without itself, weighted to the labels' real shares.

Defined results: a text without any term of the space (null and empty ones
included) has no neighbour and gets the calibrated share of examples like it;
equal cosines go to the example with the smaller id; repeated rows are scored
each by itself; labels other than 0 and 1, and labels without a text, teach
nothing; without any example every score is 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Collection
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

WORD = re.compile(r"\w+")
BLOCK = 64
#: With fewer postings of a term in a block on average, skipping blocks costs more than it saves.
FEW = 8


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def places(vocabulary: dict[str, int], found: Collection[str]) -> np.ndarray:
    """The number of each word in the vocabulary, -1 for others."""
    return np.fromiter(map(vocabulary.get, found, repeat(-1)), np.int64, len(found))


@dataclass
class Index:
    vocabulary: dict[str, int]
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    k: int
    cue: Index | None = None  # the same examples by the words most associated with the label
    scale: tuple[np.ndarray, float] = (np.zeros(4), 0.0)  # weights of the evidence in the log-odds; and the chance without neighbours
    cue_term: np.ndarray = field(default=None)  # (terms): a term's number among those of the cue, -1 for others
    first: np.ndarray = field(default=None)  # (terms + 1): where a term's postings start
    doc: np.ndarray = field(default=None)
    weight: np.ndarray = field(default=None)
    start: np.ndarray = field(default=None)  # (terms, blocks + 1): where a term's postings of a block start
    top: np.ndarray = field(default=None)  # (terms, blocks): the largest weight

    def __getstate__(self) -> dict:
        """Without the tables by block, which are much larger than the postings and are made where they are used."""
        return self.__dict__ | {"start": None, "top": None}

    def counted(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        """(terms, their counts) of a text, in the order of the terms."""
        at, n = places(self.vocabulary, counts), np.fromiter(counts.values(), np.int64, len(counts))
        some = np.flatnonzero(at >= 0)
        some = some[np.argsort(at[some])]
        return at[some], n[some]

    def vector(self, counts: Counter) -> tuple[np.ndarray, np.ndarray]:
        return self.weighted(*self.counted(counts))

    def weighted(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return at, np.zeros(0)
        v = (1 + np.log(n)) * self.idf[at]
        norm = math.sqrt(float(v @ v))
        # a word of every document weighs nothing
        return (at, v / norm) if norm else (at[:0], v[:0])

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> None:
        term = np.concatenate([t for t, _ in vectors]) if vectors else np.zeros(0, np.int64)
        doc = np.concatenate([np.full(len(t), i) for i, (t, _) in enumerate(vectors)]) if vectors else np.zeros(0, np.int64)
        weight = np.concatenate([v for _, v in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((doc, term))
        term, self.doc, self.weight = term[order], doc[order].astype(np.int32), weight[order]
        self.first = np.searchsorted(term, np.arange(len(self.idf) + 1)).astype(np.int32)
        self.start = self.top = None

    def by_block(self) -> None:
        blocks = max(1, -(-len(self.ids) // BLOCK))
        spot = np.repeat(np.arange(len(self.idf)), np.diff(self.first)) * blocks + self.doc // BLOCK
        edges = np.searchsorted(spot, np.arange(len(self.idf) * blocks + 1)).astype(np.int32)
        self.start = np.lib.stride_tricks.as_strided(edges, (len(self.idf), blocks + 1), (blocks * edges.itemsize, edges.itemsize)).copy()
        self.top = np.zeros(len(self.idf) * blocks)
        np.maximum.at(self.top, spot, self.weight)
        self.top = self.top.reshape(len(self.idf), blocks)

    def nearest(self, at: np.ndarray, q: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` nearest examples (places and cosines), as a full scan would give them."""
        if not len(at):
            return np.zeros(0, np.int64), np.zeros(0)
        if (self.first[at + 1] - self.first[at]).sum() < FEW * len(at) * (len(self.ids) / BLOCK):
            acc = self.sums(self.first[at], self.first[at + 1], q)
            place = np.flatnonzero(acc)
            place = place[place != without]
            return self.best(place, acc[place])
        if self.top is None:
            self.by_block()
        bound = q @ self.top[at]
        order = np.argsort(-bound, kind="stable")
        place, score, worst = np.zeros(0, np.int64), np.zeros(0), -1.0
        lo, step = 0, 4
        while lo < len(order) and bound[order[lo]] > 0 and not (len(score) >= self.k and bound[order[lo]] < worst - 1e-12):
            part = order[lo : lo + step]
            lo, step = lo + step, step * 3
            # the postings of all the query's terms in these blocks, summed per example
            acc = self.sums(self.start[at[:, None], part].ravel(), self.start[at[:, None], part + 1].ravel(), np.repeat(q, len(part)))
            p = np.flatnonzero(acc)
            p = p[p != without]
            place, score = self.best(np.concatenate((place, p)), np.concatenate((score, acc[p])))
            worst = score[-1] if len(score) >= self.k else -1.0
        return place, score

    def sums(self, begin: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
        """By example, the weights of the postings from ``begin`` to ``end``, each list times its ``q``."""
        length = end - begin
        ends = np.cumsum(length)
        spot = np.repeat(begin - ends + length, length)
        spot += np.arange(ends[-1])
        weight = self.weight[spot]
        weight *= np.repeat(q, length)
        return np.bincount(self.doc[spot], weights=weight, minlength=1)

    def best(self, place: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(score) > self.k:
            # exact ties go to the smaller id
            cut = np.partition(score, len(score) - self.k)[len(score) - self.k]
            near = np.flatnonzero(score >= cut - 1e-9)
            place, score = place[near], score[near]
        best = np.lexsort((self.ids[place], -np.round(score, 12)))[: self.k]
        return place[best], score[best]

    def vote(self, score: np.ndarray, place: np.ndarray) -> float | None:
        weight = score**2
        return float((weight * self.labels[place]).sum() / weight.sum()) if len(place) else None

    def evidence(self, vote: float | None, at: np.ndarray, n: np.ndarray, without: int = -1) -> list[float] | None:
        """The vote of the neighbours, that of the cue, whether there is no cue, and 1."""
        if vote is None:
            return None
        own = self.cue_term[at]
        some = np.flatnonzero(own >= 0)
        some = some[np.argsort(own[some])]
        place, cosine = self.cue.nearest(*self.cue.weighted(own[some], n[some]), without)
        cue = self.cue.vote(cosine, place)
        return [vote, cue or 0.0, float(cue is None), 1.0]

    def chance(self, evidence: list[float] | None) -> float:
        if not len(self.ids):
            return 0.0
        return self.scale[1] if evidence is None else 1 / (1 + math.exp(-min(50.0, max(-50.0, float(self.scale[0] @ evidence)))))


def chi_squared(vectors: list[Counter], labels: np.ndarray, terms: int, least: int = 3) -> list[str]:
    seen, yes = Counter(), Counter()
    for counts, label in zip(vectors, labels, strict=True):
        seen.update(counts.keys())
        if label:
            yes.update(counts.keys())
    n, n1 = len(labels), float(labels.sum())
    n0 = n - n1
    score = {}
    for w, total in seen.items():
        if least <= total < n:
            a, b = yes[w], total - yes[w]
            score[w] = n * (a * (n0 - b) - b * (n1 - a)) ** 2 / max(1e-9, total * (n - total) * n1 * n0)
    return sorted(score, key=lambda w: (-score[w], w))[:terms]


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", train: Column | None = None, per_label: int = 1500, terms: int = 300, k: int = 20) -> Index:
    """Index at most about ``per_label`` examples of each label (the documented bound), chosen by a hash of their id."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    known = known.filter(train) if train is not None else known
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    spot = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    pick = F.lit(False)
    for y, n in counts.items():
        pick = pick | ((F.col("y") == y) & (spot < math.ceil(1_000_000 * min(1.0, per_label / n))))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    picked = known.filter(pick).groupBy("id").agg(F.max("y").alias("y"))
    rows = texts.join(F.broadcast(picked), "id")  # at most about 2 * per_label rows

    def bags(batches):
        for batch in batches:
            got = [Counter(words(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([" ".join(c) for c in got]), pa.array([list(c.values()) for c in got], pa.list_(pa.int32()))], names=["id", "y", "w", "n"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sorted(rows.select("id", "y", "text").mapInArrow(tidy(bags), f"id {kind}, y int, w string, n array<int>").collect(), key=lambda r: (r["y"], r["id"]))
    bag = [Counter(dict(zip(r["w"].split(" "), r["n"], strict=True))) if r["w"] else Counter() for r in got]
    y = np.array([r["y"] for r in got], float)
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*bag)))}
    total, df = frequencies(docs, vocabulary, text_col)
    index = Index(vocabulary, np.log((1 + total) / (1 + df)), np.array([r["id"] for r in got]), y, k)
    cues = chi_squared(bag, y, terms)
    index.cue = Index({w: i for i, w in enumerate(cues)}, index.idf[[vocabulary[w] for w in cues]], index.ids, y, k)
    index.cue_term = np.full(len(vocabulary), -1, np.int64)
    index.cue_term[[vocabulary[w] for w in cues]] = np.arange(len(cues))
    vectors = [index.vector(c) for c in bag]
    index.build(vectors)
    index.cue.build([index.cue.vector(c) for c in bag])
    if len(got):
        index.scale = calibrate(index, bag, vectors, counts)
    return index


def frequencies(docs: DataFrame, vocabulary: dict[str, int], text_col: str) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each term stands."""

    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        n, df = 0, np.zeros(len(known), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                at = places(known, set(words(text)))
                df[at[at >= 0]] += 1
        some = np.flatnonzero(df)
        yield pa.record_batch({"t": pa.array(np.append(some, -1), pa.int32()), "n": pa.array(np.append(df[some], n), pa.int64())})

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(count), "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    t, n = got["t"].to_numpy(np.int64), got["n"].to_numpy(np.int64)
    df = np.zeros(len(vocabulary))
    df[t[t >= 0]] = n[t >= 0]
    return int(n[t < 0].sum()), df


def calibrate(index: Index, bag: list[Counter], vectors: list, counts: dict[int, int]) -> tuple[np.ndarray, float]:
    votes = [index.evidence(index.vote(*reversed(index.nearest(t, v, i))), *index.counted(bag[i]), i) for i, (t, v) in enumerate(vectors)]
    y = index.labels
    share = {c: counts.get(c, 0) / max(1, (y == c).sum()) for c in (0, 1)}
    weight = np.array([share[int(c)] for c in y])
    weight = weight / weight.mean()
    none = np.array([v is None for v in votes])
    base = float((weight * y)[none].sum() + 0.5) / float(weight[none].sum() + 1) if none.any() else float((weight * y).mean())
    x = np.array([v for v in votes if v is not None], float).reshape(-1, 4)
    w, goal, u = np.zeros(4), y[~none], weight[~none]
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(x.T @ (x * (u * p * (1 - p))[:, None]) + 0.01 * np.eye(4), x.T @ (u * (goal - p)) - 0.01 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w, base


def score(docs: DataFrame, index: Index, text_col: str = "text", id_col: str = "doc_id", evidence: int = 3) -> DataFrame:
    """The id, ``score`` and ``neighbours`` (the nearest examples with label and cosine)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = docs.schema[id_col].dataType.simpleString()
    near = pa.list_(pa.struct([("id", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))

    def run(batches):
        model, seen = shared.value, {}
        for batch in batches:
            scores, found = [], []
            for text in batch.column(1).to_pylist():
                key = xxhash.xxh3_128_digest((text or "").encode("utf-8", "surrogatepass"))
                if key not in seen:
                    terms = model.counted(Counter(words(text)))
                    place, cosine = model.nearest(*model.weighted(*terms))
                    if len(seen) >= 20_000:
                        seen.clear()
                    seen[key] = (model.chance(model.evidence(model.vote(cosine, place), *terms)), [{"id": int(model.ids[p]), "label": int(model.labels[p]), "cosine": float(c)} for p, c in zip(place[:evidence], cosine[:evidence], strict=True)])
                scores.append(seen[key][0])
                found.append(seen[key][1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, near)], names=[id_col, "score", "neighbours"])

    return docs.select(id_col, F.col(text_col).alias("text")).mapInArrow(tidy(run), f"{id_col} {kind}, score double, neighbours array<struct<id:bigint,label:int,cosine:double>>")
