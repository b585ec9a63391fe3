"""Both paths of the largest TF-IDF cosine against plain sums."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from brinkline.operators import similarity


def grams(text):
    words = re.findall(r"\w{2,}", (text or "").lower())
    return Counter(" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))


def plain(instructions, proxies):
    n = len(proxies) + 2
    merged: dict = {}
    for key, text in proxies:
        merged.setdefault(key, Counter()).update(grams(text))
    df = Counter(t for c in merged.values() for t in c)
    out = []
    for _, text in instructions:
        own, best = grams(text), 0.0
        i1 = {t: math.log(n / (df[t] + 2)) + 1 for t in own}
        na = sum((c * i1[t]) ** 2 for t, c in own.items())
        for other in merged.values():
            i = {t: math.log(n / (df[t] + (2 if t in own else 1))) + 1 for t in other}
            nb = sum((c * i[t]) ** 2 for t, c in other.items())
            dot = sum(c * other[t] * i1[t] ** 2 for t, c in own.items() if t in other)
            if dot:
                best = max(best, dot / math.sqrt(na * nb))
        out.append(best)
    return out


@pytest.fixture(scope="module")
def corpus():
    rnd = random.Random(9)
    common, rare = ["the", "of", "and", "to", "in"], [f"w{i}" for i in range(150)]
    text = lambda share, n: " ".join(rnd.choice(common) if rnd.random() < share else rnd.choice(rare) for _ in range(n))
    proxies = [(i, text(0.6, rnd.randrange(1, 25))) for i in range(120)] + [(500 + i, text(1.0, rnd.randrange(1, 5))) for i in range(60)] + [(None, "the lonely one"), (3, "the same key again"), (800, None), (801, "")]
    instructions = [(i, text(rnd.choice([0.3, 0.9, 1.0]), rnd.randrange(0, 30))) for i in range(80)] + [(1, "the of the"), (1, "the of the"), (None, "and to in the"), (90, None), (91, ""), (92, "unheard words"), (93, "the lonely one")]
    return instructions, proxies


@pytest.mark.parametrize(("terms", "hot", "block"), [(10**6, 8, 2000), (0, 4, 2000), (0, 4, 7), (0, 0, 13), (0, 10**6, 2000)])
def test_paths_equal_plain_sums(spark, corpus, monkeypatch, terms, hot, block):
    """Broadcast; joins with some, with all and without frequent terms; blocks of a few texts."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    mine, theirs = corpus
    a = spark.createDataFrame(mine, "id int, text string")
    b = spark.createDataFrame(theirs, "id int, text string")
    got = similarity.max_similarity(a, b, "id", "text", "id", "text", terms=terms, hot=hot).collect()
    want = [(k, s) for (k, _), s in zip(mine, plain(*corpus), strict=True)]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    assert len(got) == len(want)
    for (k, s), (j, t) in zip(order([tuple(r) for r in got]), order(want), strict=True):
        assert k == j and s == pytest.approx(t, abs=1e-9)


def test_frequent_terms_make_no_pairs(spark):
    """A term of every corpus text: what is joined stays far below texts times corpus texts."""
    proxies = spark.createDataFrame([(i, f"shared name{i % 50} own{i}") for i in range(1_000)], "id int, text string")
    mine = spark.createDataFrame([(i, f"shared own{i * 3} else{i}") for i in range(300)], "id int, text string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("cosines", "")
    out = similarity.max_similarity(mine, proxies, "id", "text", "id", "text", terms=0, hot=8).collect()
    jobs = tracker.getJobIdsForGroup("cosines")
    spark.sparkContext.setJobGroup("other", "")
    store, most = spark.sparkContext._jsc.sc().statusStore(), 0
    for job in jobs:
        for stage in tracker.getJobInfo(job).stageIds:
            try:
                most = max(most, store.lastStageAttempt(stage).shuffleWriteRecords())
            except Exception:  # a stage that was skipped
                continue
    assert len(out) == 300 and 0 < most < 30_000


def test_empty_corpus(spark):
    a = spark.createDataFrame([(1, "some text"), (2, None)], "id int, text string")
    none = spark.createDataFrame([], "id int, text string")
    for terms in (10, -1):
        assert [r.similarity for r in similarity.max_similarity(a, none, "id", "text", "id", "text", terms=terms).collect()] == [0.0, 0.0]


def test_terms_that_a_corpus_lacks_are_not_dealt_out(spark):
    """They count in the norm alone, so rows of them are not sent."""
    theirs = similarity.term_counts(spark.createDataFrame([(1, "alpha beta")], "id int, text string"), "id", "text", "b")
    mine = spark.createDataFrame([("x", "alpha beta " + " ".join(f"w{i}" for i in range(50)) + " w1 w1"), ("y", None), ("z", "none of them")], "a string, text string")
    got = similarity.known_counts(mine, "a", "text", theirs, 3).collect()
    own = grams("alpha beta " + " ".join(f"w{i}" for i in range(50)) + " w1 w1")
    assert {(r.a, r.term, r.ta) for r in got} == {("x", t, 1) for t in ("alpha", "beta", "alpha beta")}
    assert {r.rest for r in got} == {float(sum(c * c for c in own.values()) - 3)}


def test_texts_of_many_pairs_meet_the_corpus_at_once(spark):
    """Rare terms that a text shares with every corpus text: no row for each of the pairs is dealt out."""
    proxies = spark.createDataFrame([(i, f"one{i // 5} two{i // 7} own{i}") for i in range(200)], "id int, text string")
    every = " ".join(f"one{i} two{i}" for i in range(40))
    mine = spark.createDataFrame([(i, f"{every} own{i}") for i in range(150)], "id int, text string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("many pairs", "")
    out = similarity.max_similarity(mine, proxies, "id", "text", "id", "text", terms=0, hot=8).collect()
    jobs = tracker.getJobIdsForGroup("many pairs")
    spark.sparkContext.setJobGroup("other", "")
    store, most = spark.sparkContext._jsc.sc().statusStore(), 0
    for job in jobs:
        for stage in tracker.getJobInfo(job).stageIds:
            try:
                most = max(most, store.lastStageAttempt(stage).shuffleWriteRecords())
            except Exception:  # a stage that was skipped
                continue
    assert 0 < most < 10_000  # 30,000 pairs
    want = plain([tuple(r) for r in mine.collect()], [tuple(r) for r in proxies.collect()])
    assert [r.similarity for r in sorted(out)] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("dense", "block"), [(0, 2000), (0, 9), (3, 9)])
def test_texts_that_meet_the_corpus_at_once_equal_plain_sums(spark, corpus, monkeypatch, dense, block):
    """All texts, and some of them; one block and several; many parts and few sums at once."""
    for name, value in (("DENSE", dense), ("PACKED", 10**6), ("BLOCK", block), ("WIDE", 20), ("PART", 40), ("SPOTS", 50)):
        monkeypatch.setattr(similarity, name, value, raising=False)
    mine, theirs = corpus
    a = spark.createDataFrame(mine, "id int, text string")
    b = spark.createDataFrame(theirs, "id int, text string")
    got = [tuple(r) for r in similarity.max_similarity(a, b, "id", "text", "id", "text", terms=0, hot=40).collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    want = order([(k, s) for (k, _), s in zip(mine, plain(*corpus), strict=True)])
    assert [k for k, _ in order(got)] == [k for k, _ in want]
    assert [s for _, s in order(got)] == pytest.approx([s for _, s in want], abs=1e-9)


@pytest.mark.parametrize(("longest", "chunk"), [(1, 200_000), (2, 1), (3, 30), (4, 200_000)])
def test_terms_are_counted_as_word_by_word(spark, monkeypatch, longest, chunk):
    """Texts cut into chunks; letters that only newer Unicode has end a word, as they do in the corpus."""
    monkeypatch.setattr(similarity, "CHUNK", chunk, raising=False)
    rnd = random.Random(4)
    words = ["alpha", "beta", "gamma", "x", "delta", "été", "alpha\u0870beta", "\u0661\u0662", "İx"]
    texts = [(i, " ".join(rnd.choice(words + [f"w{k}" for k in range(9)]) for _ in range(rnd.randrange(25)))) for i in range(60)] + [(60, None), (61, "")]
    a = spark.createDataFrame(texts, "a int, text string")
    theirs = similarity.term_counts(spark.createDataFrame([(i, t) for i, t in texts[:12]], "id int, text string"), "id", "text", "b", longest)
    known = {r.term for r in theirs.select("term").distinct().collect()}
    all_ = {}
    for r in similarity.term_counts(a, "a", "text", "a", longest).collect():
        all_.setdefault(r.a, {})[r.term] = r.tf
    got = similarity.known_lists(a, "a", "text", theirs, longest).collect()
    assert len(got) == len(texts)
    for r in got:
        mine, counts = dict(zip(r.terms, r.tas, strict=True)), all_.get(r.a, {})
        assert mine.items() <= counts.items() and known & counts.keys() <= mine.keys()
        assert r.rest == sum(n * n for t, n in counts.items() if t not in mine)
