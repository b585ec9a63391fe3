"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is a ``buckets x languages`` matrix of log probabilities.  It is
fitted on at most about ``per_lang`` training rows of each language, chosen
by a hash of their id (the rate follows from an exact count, so the expected
size is fixed whatever the input).  The matrix, whose size depends on the
bucket count and the number of languages alone, goes to the executors as a
broadcast variable.  The n-grams of a batch of texts are hashed and gathered
at once and summed by text; long texts go on in the next part, which counts
only the n-grams that end in it, so every n-gram counts once.

The prediction is the language of the greatest log posterior, with every
n-gram of the whole text.  ``score`` is its share of the posterior after the
log posteriors of the text are divided by a temperature that grows with its
number of n-grams (they do not tell independently); the rule is fitted on
training rows that the counts have not seen and changes no prediction.

Defined results: null text or text without a letter gives ``und`` and score
0; with no training row at all every text gives ``und``; repeated rows are
scored each by itself; an exact tie goes to the language first in
alphabetical order; rows without id are scored and never learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tidy

UNKNOWN = "und"
PART = 1 << 17  # characters handled at a time
U = np.uint64
#: One odd factor for each place of an n-gram.
FACTORS = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


@dataclass(frozen=True)
class LangModel:
    langs: tuple[str, ...]
    log_prob: np.ndarray  # (buckets, langs) float32
    prior: np.ndarray
    orders: tuple[int, ...]
    temperature: tuple[float, float] = (1.0, 0.0)  # (c, e): max(1, c * n ** e) for a text of n characters


def gram_ids(chars: np.ndarray, n: int, buckets: int) -> np.ndarray:
    """Bucket of the n-gram of code points that starts at each place."""
    size = max(0, len(chars) - n + 1)
    total = np.full(size, n, U)
    for k in range(n):
        total = (total ^ chars[k : k + size]) * FACTORS[k]
        total ^= total >> U(29)
    return ((total * FACTORS[-1]) >> U(40)).astype(np.int64) % buckets


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)


def parts(texts: list[np.ndarray], carry: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(characters, text of each, whether it is new) in parts of about ``PART``.

    A text that goes on in the next part leaves its last ``carry`` characters
    there as old ones: no n-gram ends in them anew."""
    chars, owner, new, held = [], [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            back = min(at, carry)
            take = text[at - back : at + PART - held]
            chars.append(take)
            owner.append(np.full(len(take), i))
            new.append(np.arange(len(take)) >= back)
            held += len(take) - back
            at += len(take) - back
            if held >= PART:
                yield np.concatenate(chars), np.concatenate(owner), np.concatenate(new)
                chars, owner, new, held = [], [], [], 0
    if held:
        yield np.concatenate(chars), np.concatenate(owner), np.concatenate(new)


def grams(texts: list[np.ndarray], orders: tuple[int, ...], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, texts) of all n-grams of the texts, each once; the texts increase within an array."""
    for chars, owner, new in parts(texts, max(orders) - 1):
        for n in orders:
            ids = gram_ids(chars, n, buckets)
            last = slice(n - 1, n - 1 + len(ids))
            good = (owner[: len(ids)] == owner[last]) & new[last]
            yield ids[good], owner[: len(ids)][good]


def log_posteriors(model: LangModel, texts: list[str | None]) -> np.ndarray:
    """(texts, languages): prior and every n-gram of each text."""
    out = np.tile(model.prior, (len(texts), 1))
    for ids, owner in grams([code_points(t) for t in texts], model.orders, len(model.log_prob)):
        if len(ids):
            start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            out[owner[start]] += np.add.reduceat(model.log_prob[ids], start, axis=0, dtype=np.float64)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def shares(log: np.ndarray, n: np.ndarray, rule: tuple[float, float]) -> np.ndarray:
    weight = np.exp((log - log.max(axis=1, keepdims=True)) / np.maximum(1.0, rule[0] * np.maximum(n, 1) ** rule[1])[:, None])
    return weight / weight.sum(axis=1, keepdims=True)


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    train: Column | None = None,
    per_lang: int = 1500,
    buckets: int = 1 << 15,
    orders: tuple[int, ...] = (1, 2, 3),
    alpha: float = 0.5,
) -> LangModel:
    """Fit on at most about ``per_lang`` rows per language (the documented bound); every tenth
    of them, by a hash of the id, is left to the temperature."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.filter(train) if train is not None else rows
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = tuple(sorted(counts))
    if not langs:
        return LangModel((), np.zeros((buckets, 0), np.float32), np.zeros(0), orders)
    pick = F.lit(False)
    spot = F.pmod("h", F.lit(1_000_000))
    for lang in langs:
        pick = pick | ((F.col("lang") == lang) & (spot < int(np.ceil(1_000_000 * min(1.0, per_lang / counts[lang])))))
    picked = rows.filter(pick).withColumn("test", F.pmod(F.shiftright("h", 24), F.lit(10)) == 0)
    index = {lang: k for k, lang in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), buckets), np.int64)
        for batch in batches:
            own = np.array([index[x] for x in batch.column(0).to_pylist()], np.int64)
            for ids, owner in grams([code_points(t) for t in batch.column(1).to_pylist()], orders, buckets):
                total += np.bincount(own[owner] * buckets + ids, minlength=len(langs) * buckets).reshape(len(langs), buckets)
        at = np.nonzero(total)
        yield pa.record_batch({"k": pa.array(at[0], pa.int32()), "bucket": pa.array(at[1], pa.int32()), "n": pa.array(total[at], pa.int64())})

    def counted(part: DataFrame) -> np.ndarray:
        got = part.select("lang", "text").mapInArrow(tidy(count), "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()
        table = np.zeros((buckets, len(langs)))
        table[got["bucket"].to_numpy(int), got["k"].to_numpy(int)] = got["n"].to_numpy(float)
        return table

    prior = np.array([counts[x] for x in langs], float)
    prior = np.log(prior / prior.sum())
    made = lambda table: LangModel(langs, np.log((table + alpha) / (table + alpha).sum(axis=0)).astype(np.float32), prior, orders)
    own = counted(picked.filter("not test"))
    # a tenth of a bounded sample: log posteriors only, no text, reach the driver
    trial = spark.sparkContext.broadcast(made(own))

    def test(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            log = log_posteriors(trial.value, texts)
            yield pa.record_batch({"k": pa.array([index[x] for x in batch.column(0).to_pylist()], pa.int32()), "n": pa.array([len(t) for t in texts], pa.int64()), "log": pa.array(list(log), pa.list_(pa.float64()))})

    seen = picked.filter("test").select("lang", "text").mapInArrow(tidy(test), "k int, n long, log array<double>").collect()
    model = made(own + counted(picked.filter("test")))
    log, n = np.array([r["log"] for r in seen], float).reshape(-1, len(langs)), np.array([r["n"] for r in seen], np.int64)
    return LangModel(langs, model.log_prob, prior, orders, temperature(log, n, np.array([r["k"] for r in seen], np.int64)))


def temperature(log: np.ndarray, n: np.ndarray, right: np.ndarray) -> tuple[float, float]:
    """The rule with the least log loss on a grid."""
    if not len(right):
        return 1.0, 0.0
    rules = [(2 ** (k / 2) / 64**e, e) for e in (0.0, 0.5, 1.0) for k in range(-8, 17)]
    loss = lambda rule: -np.log(np.maximum(shares(log, n, rule)[np.arange(len(right)), right], 1e-12)).sum()
    return min(rules, key=loss)


def score_texts(model: LangModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    fit_ = [bool(model.langs) and has_letter(t) for t in texts]
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    some = [i for i, f in enumerate(fit_) if f]
    if some:
        log = log_posteriors(model, [texts[i] for i in some])
        best = log.argmax(axis=1)
        share = shares(log, np.array([len(texts[i]) for i in some]), model.temperature)
        for i, b, s in zip(some, best.tolist(), share[np.arange(len(some)), best].tolist(), strict=True):
            langs[i], scores[i] = model.langs[b], s
    return langs, scores


def predict(docs: DataFrame, model: LangModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` with ``lang_pred`` and ``score``; ``keep`` must not hold those two names."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    wanted = [*keep, *([] if text_col in keep else [text_col])]
    at = wanted.index(text_col)

    def run(batches):
        for batch in batches:
            langs, scores = score_texts(shared.value, batch.column(at).to_pylist())
            columns = [batch.column(k) for k in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    return docs.select(*wanted).mapInArrow(tidy(run), schema)
