import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinkline.config import FEATURES, Settings
from brinkline.operators import forest, moments, regression, similarity, summary, threshold
from brinkline.plans import catalogue, enrich, stages
from brinkline.sources import tasks
from brinkline.streaming import enrich_stream

TINY = Settings(trees=5, depth=3, folds=3, bootstrap=6, placebo=4, min_regime=30)


def kinked(n=3000, at=6.5, seed=1, jump=1.0):
    g = np.random.default_rng(seed)
    k, c = g.uniform(0, 16, n), g.normal(size=n)
    y = 0.5 * c + jump * (k > at) + g.normal(scale=0.5, size=n)
    z1, z2 = k + g.normal(size=n), g.normal(size=n)
    return np.stack([np.arange(n), k, c, y, z1, z2, z1 + z2], axis=1)


def frame(spark, data):
    return spark.createDataFrame([tuple(float(v) for v in r) for r in data], "id double, k double, c double, y double, z1 double, z2 double, z3 double")


def lstsq_rss(x, y):
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    return b, float(((y - x @ b) ** 2).sum())


def test_ols_hc1(spark):
    d = kinked(400)
    fit = regression.ols(frame(spark, d), "y", ["k", "c"], robust=True)
    x = np.stack([np.ones(400), d[:, 1], d[:, 2]], axis=1)
    b, _ = lstsq_rss(x, d[:, 3])
    e = d[:, 3] - x @ b
    inv = np.linalg.inv(x.T @ x)
    cov = inv @ (x.T @ (x * (e**2)[:, None])) @ inv * 400 / 397
    assert fit.coef == pytest.approx(b)
    assert np.sqrt(np.diag(fit.cov)) == pytest.approx(np.sqrt(np.diag(cov)))


def test_two_stage_with_collinear_instruments(spark):
    d = kinked(500)
    fit = regression.two_stage(frame(spark, d), "y", "k", ["c"], ["z1", "z2", "z3"])
    one = np.ones(500)
    z = np.stack([one, d[:, 2], d[:, 4], d[:, 5]], axis=1)
    x = np.stack([one, d[:, 2], d[:, 1]], axis=1)
    xh = z @ np.linalg.lstsq(z, x, rcond=None)[0]
    b = np.linalg.lstsq(xh, d[:, 3], rcond=None)[0]
    e = d[:, 3] - x @ b
    inv = np.linalg.inv(xh.T @ xh)
    cov = inv @ (xh.T @ (xh * (e**2)[:, None])) @ inv
    assert fit.coef == pytest.approx(b)
    assert np.sqrt(np.diag(fit.cov)) == pytest.approx(np.sqrt(np.diag(cov)))
    r1, r0 = lstsq_rss(z, d[:, 1])[1], lstsq_rss(z[:, :2], d[:, 1])[1]
    assert fit.info["f"] == pytest.approx((r0 - r1) / 2 / (r1 / (500 - 4)), rel=1e-6)
    assert fit.info["rank"] == 4 and fit.info["q"] == 2 and fit.info["partial_r2"] == pytest.approx((r0 - r1) / r0)
    assert regression.two_stage(frame(spark, d), "y", "k", ["c"], ["z1", "z2", "z3"], strict=True) is None


def test_cube_slices_equal_separate_rows(spark):
    """Nulls and NaN in every column: each slice holds the rows that its own columns allow."""
    d = kinked(600)
    g = np.random.default_rng(3)
    d[g.random(d.shape) < 0.08] = np.nan
    rows = [tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(d)]
    df = spark.createDataFrame(rows, "id double, k double, c double, y double, z1 double, z2 double, z3 double").repartition(3)
    grid = [3.0, 6.5, 10.0]
    found = moments.cube(df, ["k", "c", "z1", "y"], threshold.cell_of(F.col("k"), grid), 4)
    at = {"k": 1, "c": 2, "y": 3, "z1": 4}
    for columns in (["k", "y"], ["y"], ["z1", "c", "k", "y"], ["c", "z1"]):
        own = d[~np.isnan(d[:, [at[c] for c in columns]]).any(axis=1)]
        x = np.stack([np.ones(len(own)), *[own[:, at[c]] - found.mean[c] for c in columns]], axis=1)
        assert found.of(columns).matrix == pytest.approx(x.T @ x)
        if "k" in columns:
            for cell, m in enumerate(found.slices(columns)):
                mine = x[np.searchsorted(grid, own[:, 1], side="left") == cell]
                assert m.matrix == pytest.approx(mine.T @ mine)
    assert moments.cube(df.filter("k > 99"), ["k", "y"]).of(["k", "y"]).n == 0


def test_battery_reads_the_rows_twice(spark, monkeypatch):
    d = kinked(800)
    df = frame(spark, d).select(F.col("y").alias("pass_rate"), F.col("k").alias("kappa_actual"), F.col("k").alias("kappa_predicted"), "c", "z1", "z2")
    scans, plain = [], moments.products
    for module in (moments, regression):
        monkeypatch.setattr(module, "products", lambda df, wanted: scans.append(len(wanted)) or plain(df, wanted))
    settings = Settings(controls=("c",), instruments=("z1", "z2"), bootstrap=0, placebo=0, min_regime=30)
    out = stages.stage2(df, settings)
    assert scans == [1, 3]
    naive = regression.ols(df, "pass_rate", ["kappa_actual", "c"], robust=True)
    iv = regression.two_stage(df, "pass_rate", "kappa_actual", ["c"], ["z1", "z2"])
    assert out["naive"].coef == pytest.approx(naive.coef) and out["naive"].cov == pytest.approx(naive.cov)
    assert out["iv"].coef == pytest.approx(iv.coef) and out["iv"].cov == pytest.approx(iv.cov) and out["iv"].info == pytest.approx(iv.info)
    assert out["search"].curve == pytest.approx(threshold.search(df, "pass_rate", "kappa_predicted", ["c"], settings).curve)


def test_hausman(spark):
    d = kinked(500)
    h, p = regression.hausman(frame(spark, d), "y", "k", ["c"], ["z1", "z2"])
    one = np.ones(500)
    x, z = np.stack([one, d[:, 1], d[:, 2]], axis=1), np.stack([one, d[:, 4], d[:, 5], d[:, 2]], axis=1)
    kh = z @ np.linalg.lstsq(z, d[:, 1], rcond=None)[0]
    xh = np.stack([one, kh, d[:, 2]], axis=1)
    (b1, s1), (b2, s2) = lstsq_rss(x, d[:, 3]), lstsq_rss(xh, d[:, 3])
    v1, v2 = np.linalg.inv(x.T @ x)[1, 1] * s1 / 497, np.linalg.inv(xh.T @ xh)[1, 1] * s2 / 497
    if v2 > v1:
        assert h == pytest.approx((b2[1] - b1[1]) ** 2 / (v2 - v1), rel=1e-6) and 0 <= p <= 1
    else:
        assert h is None and p is None


def brute_curve(d, y, grid, least):
    one = np.ones(len(d))
    x = np.stack([one, d[:, 1], d[:, 2]], axis=1)
    pooled, out = lstsq_rss(x, y)[1], []
    for g in grid:
        low = d[:, 1] <= g
        if low.sum() < least or (~low).sum() < least:
            out.append(None)
            continue
        split = lstsq_rss(x[low], y[low])[1] + lstsq_rss(x[~low], y[~low])[1]
        out.append((pooled - split) / 3 / (split / (len(d) - 6)))
    return out


def test_threshold_curve_and_bootstrap(spark):
    d = kinked(900)
    found = threshold.search(frame(spark, d), "y", "k", ["c"], TINY)
    want = brute_curve(d, d[:, 3], TINY.grid, 30)
    assert found.curve == pytest.approx(want, rel=1e-8)
    assert abs(found.gamma - 6.5) <= 0.5 and len(TINY.grid) == 26 and TINY.grid[-1] == 14.5
    draws = [x for x in threshold.wild_bootstrap(found, F.col("id").cast("long"), 130) if x[0] in (1, 2, 130)]
    x = np.stack([np.ones(900), d[:, 1], d[:, 2]], axis=1)
    b, _ = lstsq_rss(x, d[:, 3])
    for draw, sup, _ in draws:
        block, bit = divmod(draw - 1, 128)
        s = np.array([1.0 - 2 * (int(hashlib.md5(f"{int(i)}-{block}".encode()).hexdigest(), 16) >> (127 - bit) & 1) for i in d[:, 0]])
        y = x @ b + (d[:, 3] - x @ b) * s
        assert sup == pytest.approx(max(v for v in brute_curve(d, y, TINY.grid, 30) if v is not None), rel=1e-7)
    assert threshold.share_at_least(draws, found.sup) == 0.0 and threshold.verdict(0.0) == "significant at 1%"


def test_placebo_keeps_the_values(spark):
    d = kinked(400)
    found = threshold.search(frame(spark, d), "y", "k", ["c"], TINY)
    fake = threshold.placebo(found, F.col("id").cast("long"), 3)
    assert len(fake) == 3 and all(2 <= g < 15 and s > 0 for _, s, g in fake)
    order = np.argsort([hashlib.md5(f"{int(i)}-0".encode()).hexdigest() for i in d[:, 0]])
    for draw, sup, _ in fake:
        moved = d[order].copy()
        moved[:, 1] = moved[threshold.Bijection(400, draw).forward(np.arange(400)), 1]
        assert sorted(moved[:, 1]) == sorted(d[:, 1]) and (moved[:, 1] != d[order, 1]).mean() > 0.9
        assert sup == pytest.approx(max(v for v in brute_curve(moved, moved[:, 3], TINY.grid, 30) if v is not None), rel=1e-7)
    ranks = threshold.ranked(spark.range(1000).withColumn("h", F.md5(F.col("id").cast("string"))), [], "h", 400_000)
    got = ranks.orderBy("h").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))


def test_bijections_of_all_sizes():
    for n in [*range(1, 40), 1000, 9_999, 65_537]:
        for draw in (1, 2, 77):
            one, place = threshold.Bijection(n, draw), np.arange(n)
            to = one.forward(place)
            assert np.array_equal(np.sort(to), place) and np.array_equal(one.backward(to), place)


def test_placebo_by_exchange_is_the_same(spark, monkeypatch):
    """Parts of 64 places and lots of 3 draws give what the values sent to all executors give."""
    monkeypatch.setattr(threshold, "DRAWS", 3)
    found = threshold.search(frame(spark, kinked(500)), "y", "k", ["c"], TINY)
    key = F.col("id").cast("long")
    whole, parted = threshold.placebo(found, key, 7), threshold.placebo(found, key, 7, held=0, part=64)
    assert [(d, g) for d, _, g in whole] == [(d, g) for d, _, g in parted]
    assert [s for _, s, _ in whole] == pytest.approx([s for _, s, _ in parted], rel=1e-9)


def test_placebo_has_the_distribution_of_independent_permutations(spark):
    d = kinked(600, jump=0.0)
    found = threshold.search(frame(spark, d), "y", "k", [], TINY)
    mine = np.sort([s for _, s, _ in threshold.placebo(found, F.col("id").cast("long"), 400)])
    g, free = np.random.default_rng(5), []
    for _ in range(400):
        moved = d.copy()
        moved[:, 1] = g.permutation(moved[:, 1])
        moved[:, 2] = 0
        x = np.stack([np.ones(600), moved[:, 1]], axis=1)
        pooled = lstsq_rss(x, moved[:, 3])[1]
        best = 0.0
        for gamma in TINY.grid:
            low = moved[:, 1] <= gamma
            if min(low.sum(), (~low).sum()) >= 30:
                split = sum(lstsq_rss(x[m], moved[m, 3])[1] for m in (low, ~low))
                best = max(best, (pooled - split) / 2 / (split / 596))
        free.append(best)
    both = np.sort(np.concatenate((mine, free)))
    gap = np.abs(np.searchsorted(mine, both, side="right") / 400 - np.searchsorted(np.sort(free), both, side="right") / 400).max()
    assert gap < 1.63 * (2 / 400) ** 0.5  # Kolmogorov-Smirnov at 1 %
    assert len(set(np.round(mine, 9))) == 400


def test_threshold_edge_cases(spark):
    none = frame(spark, kinked(20))
    found = threshold.search(none, "y", "k", ["c"], TINY)
    assert found.gamma is None and threshold.wild_bootstrap(found, F.col("id"), 2) == [] and threshold.verdict(None) == "no valid threshold"
    assert threshold.figure_threshold(none, "y", "k", ["c"], TINY) == 6.0
    odd = frame(spark, kinked(300)).unionByName(spark.createDataFrame([(1.0, float("nan"), 0.0, 0.0, 0.0, 0.0, 0.0)], none.schema))
    assert sum(c[0, 0] for c in threshold.search(odd, "y", "k", ["c"], TINY).cells) == 300


def test_similarity(spark):
    def best(instruction, corpus):
        a = spark.createDataFrame([(1, instruction)], "i int, t string")
        b = spark.createDataFrame(list(enumerate(corpus)), "j int, t string")
        return similarity.max_similarity(a, b, "i", "t", "j", "t").first()["similarity"]

    assert best("sort a list of integers", ["sort a list of strings", "reverse a string"]) == pytest.approx(0.5363499141045839)
    assert best("sort a list", ["sort a list", "x"]) == pytest.approx(1.0)
    assert best("abc def", ["zzz yyy"]) == 0.0
    assert best("", ["zzz yyy"]) == 0.0


def test_similarity_to_a_large_corpus_is_the_same(spark):
    a = spark.createDataFrame([(1, "sort a list of integers Sort"), (2, None), (3, "nothing shared"), (4, "the list of the list of")], "i int, t string")
    b = spark.createDataFrame([(1, "sort a list of strings"), (2, "reverse the list"), (3, None)], "j int, t string")
    both = []
    for limit in (0, 1000):
        both.append({r["i"]: r["similarity"] for r in similarity.max_similarity(a, b, "i", "t", "j", "t", terms=limit).collect()})
    assert both[0] == pytest.approx(both[1]) and both[0][1] > 0


def record(i, **more):
    words = "if loop class function list word " * (1 + i % 4) + "z " * (i % 11)
    return {"id": str(i), "input": words, "status": ["passed"] if i % 3 else ["failed", "pass"], "lang": "python", "code_cleaned": "x = 1", "kappa_cyclomatic": float(1 + i % 4), "e_norm": (i % 7) / 7} | more


@pytest.fixture(scope="module")
def enriched(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("records")
    source = folder / "in.jsonl"
    source.write_text("\n".join(json.dumps(record(i, note={"a": i})) for i in range(160)) + "\n")
    enrich.run(spark, str(source), str(folder / "out"))
    return str(folder / "out")


def test_enrich(spark, enriched):
    rows = [json.loads(r["value"]) for r in spark.read.text(enriched).collect()]
    one = next(r for r in rows if r["id"] == "5")
    assert one["note"] == {"a": 5} and one["iv_features"]["inst_tokens"] == len(record(5)["input"].split())
    assert one["pass_rate"] == 1.0 and one["is_success"] == 1 and one["ast_features"]["ast_cyclomatic"] == 1
    assert one["m_mem_jaccard"] == 0.0 and one["coupling_depth"] == 0 and one["kappa_cyclomatic"] == 2.0
    assert set(one["iv_features"]) == set(FEATURES)


def test_missing_is_not_null(spark):
    df = spark.createDataFrame([('{"e_norm": null}',), ("{}",)], "j string").select(F.parse_json("j").alias("record"))
    assert [r[0] for r in df.select(tasks.field(F.col("record"), "e_norm", "double", 0.5)).collect()] == [None, 0.5]


def test_stages(spark, enriched, tmp_path):
    out = stages.stage1(spark, enriched, str(tmp_path / "model"), TINY)
    scored = out.scored
    assert scored.count() == 160 and scored.filter("kappa_predicted is null or kappa_predicted < 0 or kappa_predicted_oof is null").count() == 0
    assert [r["feature"] for r in out.importances.collect() if r["feature"] in ("inst_conditional_count", "inst_collection_count")] == [] and out.importances.count() == 8
    again = forest.predict(forest.load(str(tmp_path / "model")), tasks.load_stage2(spark, enriched), list(Settings().instruments))
    assert again.count() == 160
    result = stages.stage2(scored, TINY, summary_path=str(tmp_path / "summary"))
    assert result["naive"].n == 160 and set(result["facts"]) >= {"gamma", "hausman"}
    assert spark.read.text(str(tmp_path / "summary")).count() == 8
    data = stages.figures(scored, TINY)
    assert data["curve"].count() == 26 and data["naive"].count() == 4
    assert tasks.load_static_figures(spark, enriched).count() == tasks.load_interactive_figures(spark, enriched).count() == 160


def test_rows_without_ids_stay_apart(spark):
    """Missing and repeated ids neither multiply rows nor move together."""
    g = np.random.default_rng(3)
    rows = [("" if i % 2 else "same", float(i % 5), float(x), int(i % 3 > 0), 1.0) for i, x in enumerate(g.uniform(1, 9, 60))] + [("", 1.0, 2.0, 1, 1.0)] * 5
    df = spark.createDataFrame(rows, "id string, f double, kappa_actual double, is_success int, pass_rate double")
    out = forest.train(df, ["f"], settings=TINY)
    got = out.scored.toPandas()
    assert len(got) == 65 and got["kappa_predicted_oof"].notna().all() and list(out.scored.columns[:5]) == df.columns
    out.release()
    keys = [r[0] for r in forest.with_row_key(df).select(forest.ROW).collect()]
    assert len(set(keys)) == 65
    signs = forest.with_row_key(df).select(threshold.sign_hashes(F.col(forest.ROW), 1)[0]).distinct().count()
    assert signs == 65


def test_samples_and_folds(spark, enriched, tmp_path):
    lines = tasks.sample_lines(spark, enriched, 25)
    assert lines.count() == 25 and tasks.sample_lines(spark, enriched, 999).count() == 160
    assert spark.read.text(tasks.write_temporary(lines, str(tmp_path))).count() == 25
    sizes = [r["count"] for r in forest.folds(spark.range(101), "id", 10).groupBy("fold").count().collect()]
    assert sum(sizes) == 101 and max(sizes) - min(sizes) <= 1
    assert tasks.read_proxy(spark, str(tmp_path / "none.txt")).count() == 0


def test_summaries(spark):
    df = spark.createDataFrame([(1.0, 0.2, 0), (1.0, 0.4, 1), (2.0, 0.6, 0), (20.0, 1.0, 1)], "kappa_actual double, v double, is_success int")
    assert summary.fake_simple(df).count() == 1 and summary.successes(df).count() == 2
    assert summary.regime_report(df, "kappa_actual", "v", 1.5).first()["n_high"] == 2
    assert summary.binned_trend(df, "kappa_actual", "v", 4).count() == 1
    assert summary.flow(df, "kappa_actual", "v", 0).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jsonl").write_text(json.dumps(record(1)) + "\n" + json.dumps(record(2)) + "\n")
    q = enrich_stream.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_exchange_of_a_placebo_sends_packed_values(spark):
    """Many rows and few values: what is shuffled is about a byte for each row and draw."""
    rows = spark.range(60_000).select(F.col("id").alias("key"), (F.col("id") % 17 + 0.25).alias("k"), F.sin("id").alias("y"))
    found = threshold.search(rows, "y", "k", [])
    tracker, store = spark.sparkContext.statusTracker(), spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext.setJobGroup("exchange", "")
    got = threshold.placebo(found, F.col("key"), 60, held=100, part=7_000)
    sent = 0
    for job in tracker.getJobIdsForGroup("exchange"):
        for stage in tracker.getJobInfo(job).stageIds:
            try:
                sent += store.lastStageAttempt(stage).shuffleWriteBytes()
            except Exception:  # a stage that was skipped
                continue
    spark.sparkContext.setJobGroup("other", "")
    assert np.allclose(got, threshold.placebo(found, F.col("key"), 60)) and sent < 3 * 60 * 60_000
    wide = threshold.search(rows.withColumn("k", F.pmod(F.hash("key"), F.lit(10**6)) / 60_000.0), "y", "k", [])
    assert np.allclose(threshold.placebo(wide, F.col("key"), 3, held=100, part=7_000), threshold.placebo(wide, F.col("key"), 3))


def test_trees_of_drawn_rows_are_fitted_to_few_weighted_rows(spark, tmp_path):
    """However many rows there are, a tree's fit sees one for each fold and different features, and predicts their drawn mean."""
    own = Settings(trees=4, depth=5, folds=3)
    df = spark.range(3000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") % 4).alias("a"), (F.floor(F.col("id") / 12) % 3).alias("b"), F.sin("id").alias("y"))
    rows = forest.assembled(df, ["a", "b"]).select("key", "fold", "y", "features").persist()
    bag = forest.bags(rows, "y", "key", own).toPandas()
    assert len(bag) == 4 * 3 * 12 and set(bag["tree"]) == {0, 1, 2, 3}
    drawn = bag.groupby("tree")["weight"].sum()
    assert drawn.between(2700, 3300).all() and drawn.nunique() > 1
    *parts, whole = forest.fitted(rows, "y", "key", own)
    assert len(parts) == 3 and whole.getNumTrees == 4
    bag["point"], bag["sum"] = bag["features"].map(tuple), bag["y"] * bag["weight"]
    for k, model in [*enumerate(parts), (None, whole)]:
        seen = bag if k is None else bag[bag["fold"] != k]
        sums = seen.groupby(["point", "tree"])[["sum", "weight"]].sum()
        want = (sums["sum"] / sums["weight"]).groupby("point").mean()
        got = {tuple(r["features"]): r["prediction"] for r in model.transform(rows.select("features").distinct()).collect()}
        assert len(got) == 12 and all(got[p] == pytest.approx(want[p], abs=1e-9) for p in got)
    forest.save(whole, str(tmp_path / "trees"))
    again = forest.load(str(tmp_path / "trees"))
    assert again.getNumTrees == 4 and [r["prediction"] for r in again.transform(rows).collect()] == [r["prediction"] for r in whole.transform(rows).collect()]
    rows.unpersist()


def test_fits_take_no_more_tasks_than_cores(spark, monkeypatch):
    """Each level of each fit is a job over the rows, so their parts must not be as many as those of a shuffle."""
    parts, fitted = [], forest.fitted
    monkeypatch.setattr(forest, "fitted", lambda rows, *more: (parts.append(rows.rdd.getNumPartitions()), fitted(rows, *more))[1])
    monkeypatch.setattr(forest, "ranked", lambda df, group, by, n: ranked_in_many_parts(df, by))
    df = spark.range(300).select((F.col("id") % 7).alias("f"), F.sin("id").alias("kappa_actual"), F.lit(1).alias("is_success"))
    out = forest.train(df, ["f"], settings=Settings(trees=1, depth=2, folds=2, resample_rows=False))
    assert out.scored.count() == 300 and parts and max(parts) <= spark.sparkContext.defaultParallelism
    out.release()


def ranked_in_many_parts(df, by):
    return threshold.ranked(df, [], by, 300).repartition(24)


def test_sensitivity_reads_the_texts_once(spark, monkeypatch):
    kept, train, sensitivity = [], forest.train, forest.sensitivity
    note = lambda own: lambda df, *a, **k: (kept.append((df, df.storageLevel.useMemory)), own(df, *a, **k))[1]
    monkeypatch.setattr(forest, "train", note(train))
    monkeypatch.setattr(forest, "sensitivity", note(sensitivity))
    assert catalogue.forest_sensitivity(spark, "/root/testdata/sf0.001").count() == 1
    assert len(kept) == 2 and kept[0][0] is kept[1][0] and all(memory for _, memory in kept)
    assert not kept[0][0].storageLevel.useMemory
