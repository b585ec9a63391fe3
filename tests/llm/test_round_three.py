"""Alignment of tokenizers, spelling variants and risk-controlled quality rules against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from brinkline.llm import align, quality, queries, spelling

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a\n  b", "word\t  next\r\n end ", "x▁y z", "<|endoftext|> plain <s> </s> <0x41> [UNK]", "naïve café ﬁ ½ Ⅷ", "你好，世界 2024年",
    "emoji 👩‍👩‍👧 and flags 🇩🇪!", "tabs\t\tand\x0bvertical\x0c feeds\x1c \x85 x", "it's they'll we've I'd", "a b 　c ᠎ d​ e", "nul\x00 byte \x7f", "x" * 3000, " ".join(["the cat"] * 200), "é" * 50, "the cat", "the cat",
]


@pytest.fixture(scope="module")
def texts(spark):
    words = random.Random(5)
    more = ["".join(words.choice("ab cdé\n .9") for _ in range(words.randrange(1, 60))) for _ in range(60)]
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(40)  # a fixture, brute force follows
    return ODD + more + [r.text for r in docs.collect()]


def test_components_match_plain_union_find():
    rnd = random.Random(1)
    for _ in range(30):
        n = rnd.randrange(1, 40)
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(rnd.randrange(0, 50))]
        of = list(range(n))
        for a, b in edges:
            low, high = min(of[a], of[b]), max(of[a], of[b])
            of = [low if x == high else x for x in of]
        u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        first = {c: of.index(c) for c in set(of)}
        assert align.components(n, u, v).tolist() == [first[c] for c in of]


def plain_alignment(texts):
    """Per text (A ids, B ids, groups, links) from both tokenizers on the whole text."""
    import sentencepiece
    from tokenizers import Tokenizer

    files = queries.byte_vocabulary(), queries.piece_model()
    a_side, b_side = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a_side.encode_special_tokens = True
    spell = align.spellings(*files)
    out = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        if not text or b"".join(spell[0][i] for i in a) != whole or b"".join(spell[1][i] for i in b) != whole:
            out.append(([], [], [], []))
            continue
        ends = []
        for ids, side in ((a, spell[0]), (b, spell[1])):
            at, own = 0, []
            for i in ids:
                at += len(side[i])
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = []
        for low, high in zip([0, *cuts], cuts, strict=False):
            groups.append([[i for i, e in zip(ids, own, strict=True) if low < e <= high] for ids, own in ((a, ends[0]), (b, ends[1]))])
        links = [(i, j) for i, e in zip(a, ends[0], strict=True) for j, f in zip(b, ends[1], strict=True) if e == f] if len(a) < 2000 else [(g[0][-1], g[1][-1]) for g in groups]
        out.append((a, b, groups, links))
    return out


def test_alignment_matches_whole_texts(spark, texts, tmp_path):
    path = str(tmp_path / "documents.parquet")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, links string").repartition(3)
    docs.write.parquet(path)
    found = {r.doc_id: r for r in queries.op11_align(spark, str(tmp_path)).collect()}
    want = plain_alignment(texts)
    count = Counter(link for *_, links in want for link in links)
    top: dict[int, int] = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    assert len(found) == len(texts)
    for i, (a, b, groups, links) in enumerate(want):
        text = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        r = found[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (len(a), len(b), len(groups), len(links)), texts[i]
        assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if text else "")
        assert (r.n_best, r.count_sum) == (sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links))
    assert found[ODD.index("x▁y z")].n_a == 0


def test_alignment_forgets_without_changing_results(texts):
    files = queries.byte_vocabulary(), queries.piece_model()
    whole, small = align.Aligner(*files), align.Aligner(*files, remember=8)
    for at in range(0, len(texts), 5):
        a, b = whole.batch(texts[at : at + 5]), small.batch(texts[at : at + 5])
        assert (a[0] == b[0]).all() and a[1] == b[1] and (a[2] == b[2]).all() and (a[3] == b[3]).all()
    assert len(small.number) < len(whole.number)


def test_pairs_are_bounded_by_the_vocabularies(texts):
    files = queries.byte_vocabulary(), queries.piece_model()
    most = align.most_pairs(*files)
    assert len({x for *_, links in plain_alignment(texts) for x in links}) < most < 2_000_000


def test_alignment_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    found = align.align(empty, queries.byte_vocabulary(), queries.piece_model())
    assert align.score(found, align.pair_counts(found, 32000)).count() == 0


def near(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(counts: dict[str, int], times: int = 5):
    out = {}
    for w in counts:
        close = [v for v in counts if near(w, v)]
        top = min(close, key=lambda v: (-counts[v], v), default=None)
        form = top if top is not None and counts[top] >= times * counts[w] else None
        out[w] = [form, len(close), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].append(root)
    return out


@pytest.mark.parametrize("crowd", [1, 3, 64])
def test_spelling_groups_match_brute_force(spark, crowd):
    rnd = random.Random(7)
    words = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 8))) for _ in range(250)}
    words |= {"prefix" + c + d for c in "abcdefgh" for d in "xyzw"} | {c + "suffix" for c in "abcdefghij"} | {"a", "b", "ab", "×÷×÷×÷"}
    counts = {w: rnd.choice([5, 6, 25, 30, 150, 700, 4000]) for w in words}
    rows = spelling.groups(spark.createDataFrame(list(counts.items()), "word string, n long"), crowd=crowd).collect()
    want = plain_groups(counts)
    assert len(rows) == len(counts)
    for r in rows:
        assert [r.form, r.n_near, r.form_n, r.root] == want[r.word], r.word
        assert r.n == counts[r.word]


def plain_words(rows, least=5):
    out: Counter = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 199 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            out[word] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= least}


def test_words_of_documents_match_brute_force(spark, texts, monkeypatch):
    rnd = random.Random(3)
    rows = list(enumerate(texts)) + [(None, "Ünïcode ÀÉ×÷ÿ straße NAÏVE naïve"), (7, "repeated words repeated words"), (7, "repeated words repeated words"), (9, "z" * 400), (10, "Ωabcdefgāhijklmn")]
    rows += [(1000 + i, " ".join(rnd.choice(["Rätsel", "chapter", "chaptér", "PORTION"]) for _ in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_words(rows, least=1)
    for size in (1 << 20, 16):
        monkeypatch.setattr(spelling, "SLICE", size)
        assert {w for text in (t or "" for _, t in rows) for part in spelling.runs(text) for w in part} == {
            "".join(c.lower() if "A" <= c <= "Z" else c for c in x).encode("latin-1") for _, t in rows for x in re.findall("[A-Za-zÀ-ÿ]+", t or "")
        }
    assert {r.word: r.n for r in spelling.word_counts(docs, least=1).collect()} == want
    assert any(len(w) == 6 and w in ("chaptr", "chpter", "capter", "hapter", "chater", "chaper", "chapte") for w in want)  # planted deletions


def test_spelling_query_on_documents(spark):
    got = queries.op12_spelling(spark, "/root/testdata/sf0.001")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    counts = plain_words(rows)
    want = plain_groups(counts)
    assert {r.word: [r.form, r.n_near, r.form_n, r.root] for r in got.collect()} == want
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]


def test_spelling_of_an_empty_table(spark):
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert spelling.groups(spelling.word_counts(empty)).count() == 0


def plain_measures(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_measures_match_brute_force(spark, texts):
    rnd = random.Random(11)
    own = [*texts, "a b c d e a b c d e", "a a a a a a", "a a a a a", "a b c d", "a\n a\na\n\na", "## $ |", "\n\n", " ".join(rnd.choice("ab") for _ in range(300)), "w " * 5000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "doc_id long, text string")
    rows = quality.measures(docs).collect()
    assert len(rows) == len(own)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_measures(own[r.doc_id]), own[r.doc_id]


def test_measures_run_no_python(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = quality.measures(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_binomial_bounds_are_exact(spark):
    cases = [(0, 1), (0, 300), (1, 300), (3, 500), (0, 20_000), (250, 20_000), (370, 20_000), (399, 20_000), (1_000, 60_000)]
    rows = spark.createDataFrame(cases, "k long, n long")
    tail = lambda k, n, p: math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
    found = rows.select("k", "n", quality.binomial_tail(F.col("k"), F.col("n"), F.lit(0.02)).alias("tail"), quality.upper_bound(F.col("k"), F.col("n"), F.lit(0.01), 0.02).alias("most")).collect()
    for r in found:
        assert r.tail == pytest.approx(tail(r.k, r.n, 0.02), rel=1e-9)
        if r.most < 1:
            assert tail(r.k, r.n, r.most) == pytest.approx(0.01, rel=1e-6)
        else:
            assert tail(r.k, r.n, 0.02) > 0.01


def test_rules_keep_their_risk_and_equal_the_sql(spark, tmp_path):
    """Strata with separable, overlapping and too few labelled rows; null strata, ids and labels; clashing columns."""
    rnd = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa"]
    docs, labels = [], []
    for i in range(6_000):
        lang = ("en", "de", None, "rare")[0 if i % 7 < 3 else 1 if i % 7 < 5 else 2 if i % 100 else 3]
        bad = rnd.random() < 0.25
        n = rnd.randrange(20, 60)
        noisy = rnd.random() < (0.9 if bad else 0.15 if lang == "de" else 0.0)
        text = " ".join("".join(rnd.choice(words) + rnd.choice(words)) + ("##" if noisy and rnd.random() < 0.5 else "") for _ in range(n))
        docs.append((i, text, lang, "s", len(text), i))
        labels.append((i, None if i % 50 == 0 else int(not bad), 0))
    docs += [(None, "no id at all " * 9, "en", "s", 1, 1), (6_000, None, "en", "s", 0, 1), (6_001, "", None, "s", 0, 1)]
    labels += [(99_999, 1, 0), (None, 1, 0), (5, 1, 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, stratum long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op13_quality(spark, str(tmp_path)).toPandas()
    db = duckdb.connect()
    for name in ("documents", "labels"):
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    order = ["doc_id", "n_words", "word_chars"]
    want = db.sql(queries.OP13_SQL).df()[got.columns].sort_values(order).reset_index(drop=True)
    got = got.sort_values(order).reset_index(drop=True)
    for table in (got, want):
        table["doc_id"] = table["doc_id"].fillna(-1).astype(int)
    assert got.astype(str).equals(want.astype(str))
    kept = {r.doc_id: r.kept for r in got.itertuples()}
    good = {i: q for i, q, _ in labels if q is not None}
    bad_rejected = [not kept[i] for i, _, lang, *_ in docs if lang == "en" and i is not None and good.get(i) == 0]
    assert sum(bad_rejected) > 0.8 * len(bad_rejected)
    for lang in ("en", "de", None, "rare"):
        own = [not kept[i] for i, _, x, *_ in docs if x == lang and good.get(i) == 1 and hashlib.md5(str(i).encode()).hexdigest()[0] >= "c"]
        assert sum(own) <= 0.04 * len(own)  # rows that took no part
    assert all(kept[i] for i, t, lang, *_ in docs if lang == "rare" and i is not None)  # too few to certify


def test_quality_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality long")
    assert quality.apply(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "just a few words here that are ten or more in all", None)], "doc_id long, text string, lang string")
    assert [r.kept for r in quality.apply(one, labels).collect()] == [True]
