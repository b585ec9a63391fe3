"""Groups of spelling variants: frequent words one edit apart, led to their most frequent form.

Words one insertion, deletion or replacement apart are found by an
even-partition pigeonhole join.  A word of length L is cut into two segments,
of L // 2 and the rest, and indexed by both.  One edit leaves one segment
untouched, so a word of length L or L + 1 is looked up by what would be the
first segment at its place and the second one as far shifted as the word is
longer.  A segment that many words share is not joined: what is left of its
words is cut in two again (the same argument holds for it), as often as
needed, down to one character, where the alphabet bounds the words of a group.
So no group of candidates outgrows a bound and none is dropped.  Candidates are deduplicated and checked by their edit distance.

Defined results: null texts have no words; a row without id counts with the
empty string for it; repeated rows count as often as they are there; of equally
frequent forms the smallest word in code-point order is taken; an empty table
gives no rows.  Texts are read whole, in slices cut between runs.
"""

from __future__ import annotations

import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, tidy, written

SLICE = 1 << 20  # characters of a text handled at a time
HELD = 200_000  # words counted in a task before their counts are handed on
CROWD = 64  # words of a segment beyond which it is cut again
LETTERS = bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0xC0, 0x100))
LOWER = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in LETTERS else 0x20 for b in range(256))


def runs(text: str):
    """Lists of the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+``, A-Z lower-cased, as Latin-1 bytes."""
    at, rest = 0, b""
    while at < len(text):
        part = rest + text[at : at + SLICE].encode("latin-1", "replace").translate(LOWER)
        at += SLICE
        rest = b""
        if at < len(text):
            cut = part.rfind(b" ") + 1
            part, rest = part[:cut], part[cut:]
        yield part.split()


def seen(run_: bytes, crc: int, every: int) -> str:
    """The word that a run counts as: ``every`` th ones by hash lose a code point."""
    word = run_.decode("latin-1")
    h = zlib.crc32(run_ if run_.isascii() else word.encode("utf-8"), crc)
    if h % every == 0:
        k = h % len(word)
        word = word[:k] + word[k + 1 :]
    return word


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least_length: int = 6, least: int = 5) -> DataFrame:
    """``word, n``: the distinct words of at least ``least_length`` code points and ``least`` occurrences."""
    small_batches(docs.sparkSession)

    def counted(counts: Counter) -> pa.RecordBatch:
        words = [w for w in counts if len(w) >= least_length]
        return pa.record_batch({"word": pa.array(words, pa.string()), "n": pa.array([counts[w] for w in words], pa.int64())})

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                crc = zlib.crc32(f"{key}:".encode())
                for found in runs(text):
                    for own, n in Counter(found).items():
                        if len(own) >= least_length:
                            held[seen(own, crc, every)] += n
                    if len(held) >= HELD:
                        yield counted(held)
                        held.clear()
        yield counted(held)

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    return texts.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def piece(word: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` .. ``end`` - 1 of a word, from 0."""
    return word.substr(start + 1, end - start)


def halves(entries: DataFrame) -> DataFrame:
    """The two keys of each entry, and what is left of its word beside the segment that each key holds.

    An entry is a word whose characters outside ``low`` .. ``high`` - 1 (those
    of the indexed word, ``longer`` fewer than its own) match by its key.
    """
    mid = F.col("low") + F.floor((F.col("high") - F.col("low")) / 2).cast("int")
    first = F.struct(F.lit("<").alias("side"), piece(F.col("word"), F.col("low"), mid).alias("segment"), mid.alias("low"), F.col("high").alias("high"))
    second = F.struct(F.lit(">").alias("side"), piece(F.col("word"), mid + F.col("longer"), F.col("high") + F.col("longer")).alias("segment"), F.col("low").alias("low"), mid.alias("high"))
    return entries.select("word", "longer", "probe", F.col("key").alias("__key"), F.explode(F.array(first, second)).alias("s")).select(
        "word", "longer", "probe", F.concat("__key", "s.side", "s.segment").alias("key"), F.col("s.low").alias("low"), F.col("s.high").alias("high")
    )


def entries_of(words: DataFrame) -> DataFrame:
    """Each word as indexed by its length and as looking for words of its length and of one less."""
    size = F.length("word")
    roles = F.array(*[F.struct(F.lit(probe).alias("probe"), F.lit(longer).alias("longer")) for probe, longer in ((False, 0), (True, 0), (True, 1))])
    rows = words.select("word", size.alias("size"), F.explode(roles).alias("r")).select("word", F.col("r.probe").alias("probe"), F.col("r.longer").alias("longer"), (F.col("size") - F.col("r.longer")).cast("int").alias("high"))
    return rows.filter("high > 0").select("word", "longer", "probe", F.concat(F.col("high").cast("string"), F.lit(":")).alias("key"), F.lit(0).alias("low"), "high")


def met(entries: DataFrame) -> DataFrame:
    """Pairs of different words of a key, the indexed one as ``a``; of equally long ones each pair once."""
    index = entries.filter("not probe").select("key", F.col("word").alias("a"))
    probe = entries.filter("probe").select("key", F.col("word").alias("b"), "longer")
    return index.join(probe, "key").filter((F.col("longer") == 1) | (F.col("a") < F.col("b"))).select("a", "b")


def near_pairs(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a, b``: all pairs of words one edit apart, each once, the shorter or smaller first."""
    found, entries, tables = [], entries_of(words), []
    while True:
        entries = written(halves(entries), "segments")
        tables.append(entries)
        sizes = entries.groupBy("key").agg(F.count_if(~F.col("probe")).alias("index"), F.count_if(F.col("probe")).alias("probes"))
        sizes = written(sizes.filter("index > 0 and probes > 0"), "sizes")  # keys that meet at all
        often = sizes.filter((F.col("index") > crowd) | (F.col("probes") > 3 * crowd)).select("key")
        tables.append(sizes)
        frequent = often.take(1)
        if not frequent:
            found.append(met(entries))
            break
        crowded = entries.join(often, "key", "left_semi")
        found.append(met(entries.join(often, "key", "left_anti")))
        found.append(met(crowded.filter("high - low <= 1")))  # what is left is equally long in all entries of a key
        entries = crowded.filter("high - low > 1")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = written(out.filter(F.levenshtein("a", "b", 1) == 1).distinct(), "near")
    for one in tables:
        dropped(one)
    return out


def groups(words: DataFrame, times: int = 5, crowd: int = CROWD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of words with their counts ``n``.

    ``form`` is the near word of largest count, if that is ``times`` the
    word's own; ``root`` follows the forms to the last, by doubling the steps.
    """
    words = written(words.select("word", "n"), "words")
    pairs = near_pairs(words, crowd)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counted = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = counted.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("b").alias("form"))).alias("best"))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    is_form = F.col("form_n") >= times * F.col("n")
    rows = written(rows.select("word", "n", "n_near", F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")), "forms")
    steps = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # counts grow by a factor with each step, so there are few
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(steps.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        steps = after.select("word", "root")
        if not after.filter("moved").take(1):
            break
    return rows.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
