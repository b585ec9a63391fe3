"""Registered queries over the driver tables, with the SQL that checks them.

Each query is a function of (spark, sf_dir); its SQL, where it has one, is
the entry of the same name in ``SQL``.  Doubles are rounded to six places on
both sides.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import binning, code_metrics, status, text
from ..operators import forest, regression, similarity, summary, threshold
from ..operators.moments import gram
from ..sources import scratch, tasks
from ..streaming import curve_stream
from . import sql_surface, stages
from .enrich import enrich

#: Words that the driver's prose has, in place of the instruction lexicon.
FIXTURE_LEXICON = {"if": ("the", "of"), "conditional": ("la", "le"), "loop": ("de", "and"), "collection": ("in",), "class": ("der", "die"), "func": ("el", "que"), "logic": ("is", "it")}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def whole(df: DataFrame, *columns: str) -> DataFrame:
    """Counts as BIGINT."""
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


# --- scans, text, status -------------------------------------------------


def text_features_documents(spark, sf_dir):
    f = read(spark, sf_dir, "documents").select("doc_id", text.instruction_features(F.col("text"), FIXTURE_LEXICON).alias("f")).select("doc_id", "f.*")
    counts = [c for c in f.columns if c not in ("doc_id", "inst_avg_word_len")]
    return rounded(whole(f, *counts), "inst_avg_word_len")


def lexicon_features_pages(spark, sf_dir):
    f = read(spark, sf_dir, "pages").select("page_id", text.instruction_features(F.col("html")).alias("f"))
    return whole(f.select("page_id", "f.inst_class_count", "f.inst_collection_count", "f.inst_func_count"), "inst_class_count", "inst_collection_count", "inst_func_count")


def token_stats(spark, sf_dir):
    t = F.col("text")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_count(t).cast("long").alias("n_tokens"), r6(text.mean_token_length(t)).alias("mean_len"))


def intent_scores(spark, sf_dir):
    f = read(spark, sf_dir, "documents").select("doc_id", text.intent_features(F.col("text")).alias("f")).select("doc_id", "f.*")
    return rounded(whole(f, "nesting_intent", "algo_intent"), "instruction_complexity_score")


def pass_rate_list(spark, sf_dir):
    """"user" turns stand for passed checks."""
    role = F.when(F.col("role") == "user", "PASSED").otherwise(F.col("role"))
    rows = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(role).alias("status"))
    rate = status.list_pass_rate(F.col("status"))
    return rows.select("conv_id", r6(rate).alias("pass_rate"), status.success(rate).alias("is_success"))


def pass_rate_string(spark, sf_dir):
    """Status strings of three kinds made from parts: a literal list, text that is no literal, none."""
    words = lambda word, n: F.array_repeat(F.lit(word), (F.col("p_size") % n).cast("int"))
    listed = F.concat(F.lit("["), F.array_join(F.concat(words("'Pass'", 4), words("'fail'", 3)), ", "), F.lit("]"))
    loose = F.concat(F.when(F.col("p_size") % 2 == 1, "PASSED ").otherwise("no "), F.col("p_name"))
    kind = F.when(F.col("p_partkey") % 3 == 0, listed).when(F.col("p_partkey") % 3 == 1, loose)
    return read(spark, sf_dir, "part").select("p_partkey", r6(status.string_pass_rate(kind)).alias("pass_rate"))


def json_flatten(spark, sf_dir):
    records = read(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("record"))
    return records.select("event_id", tasks.field(F.col("record"), "k", "long", 0).alias("k"))


def defaults_fill(spark, sf_dir):
    """Records without some keys, flattened as every load does."""
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    member = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("quality").alias("kappa_cyclomatic"), F.col("toxic").alias("is_success"), "lang")
    return tasks.flat(rows.select(F.parse_json(F.to_json(member)).alias("record"))).select("id", "kappa_actual", "is_success", "lang", "e_norm", "coupling_depth", "pass_rate")


def success_split(spark, sf_dir):
    rows = read(spark, sf_dir, "labels").withColumn("is_success", F.col("quality"))
    good = summary.successes(rows).agg(F.count("*").alias("n"), F.avg("toxic").alias("mean_toxic")).withColumn("side", F.lit("success"))
    bad = summary.failures(rows).agg(F.count("*").alias("n"), F.avg("toxic").alias("mean_toxic")).withColumn("side", F.lit("failure"))
    return rounded(good.unionByName(bad), "mean_toxic")


def load_report(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("kappa", F.col("n_chars") / 100.0)
    return rounded(summary.load_report(rows, "quality", "toxic", "n_chars", "kappa"), "success_rate", "mean_pass_rate", "mean_actual", "mean_predicted")


def fake_simple_report(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id").withColumn("n_tokens", text.token_count(F.col("text")))
    rows = rows.select((1 - F.col("toxic")).alias("kappa_actual"), F.col("quality").alias("is_success"), "n_tokens")
    return rounded(whole(summary.spread_report(summary.fake_simple(rows), "n_tokens"), "max"), "mean", "median")


# --- views and bins ------------------------------------------------------


def regime_report(spark, sf_dir):
    return rounded(summary.regime_report(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", 6.5), "mean_low", "mean_high", "difference")


def naive_view(spark, sf_dir):
    return rounded(summary.naive_view(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount"), "mean_outcome")


def naive_view_clipped(spark, sf_dir):
    return rounded(summary.naive_view(read(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", 1, 12), "mean_outcome")


def _predicted(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").withColumn("predicted", F.col("l_quantity") / 2)


def corrected_view(spark, sf_dir):
    return rounded(summary.corrected_view(_predicted(spark, sf_dir), "predicted", "l_discount"), "mean_outcome")


def corrected_view_clipped(spark, sf_dir):
    return rounded(summary.corrected_view(_predicted(spark, sf_dir), "predicted", "l_discount", (1, 12)), "mean_outcome")


def observed_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").filter(F.col("l_quantity").between(1, 8))
    return rows.groupBy(binning.observed_label(F.col("l_quantity").cast("int")).alias("label")).agg(F.count("*").alias("n"))


def equal_width_bins(spark, sf_dir):
    rows = binning.equal_width(read(spark, sf_dir, "lineitem"), "l_extendedprice", 15, "bin")
    return rows.groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


def explicit_bins_flow(spark, sf_dir):
    rows = _predicted(spark, sf_dir).withColumn("observed", F.col("l_tax") * 100 + 1)
    return whole(summary.flow(rows, "predicted", "observed"), "pred_bin", "obs_bin", "wrong")


def flow_labels(spark, sf_dir):
    rows = _predicted(spark, sf_dir).withColumn("observed", F.col("l_tax") * 100 + 1)
    return summary.flow_labels(whole(summary.flow(rows, "predicted", "observed"), "pred_bin"), "pred_bin")


def phase_cells(spark, sf_dir):
    return rounded(whole(summary.phase_cells(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", 15, 15), "k_bin", "e_bin"), "mean_outcome")


def phase_pivot(spark, sf_dir):
    out = summary.phase_pivot(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", 6, 3)
    return out.select(F.col("k_bin").cast("long").alias("k_bin"), *[r6(f"`{i}`").alias(f"e{i}") for i in (1, 2, 3)])


def phase_labelled(spark, sf_dir):
    return rounded(whole(summary.phase_cells(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_discount", 12, 8, labels=True), "k_bin", "e_bin"), "mean_outcome")


def binned_trend(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("y", F.col("o_custkey") * 1.0)
    return rounded(whole(summary.binned_trend(rows, "o_totalprice", "y"), "bin"), "mean_kappa", "mean_pass", "se", "low", "high")


def violin_stats(spark, sf_dir):
    return rounded(summary.violin(read(spark, sf_dir, "lineitem"), "l_linenumber", "l_extendedprice"), "min", "q1", "median", "q3", "max", "mean")


def corr_failures(spark, sf_dir):
    return rounded(summary.correlation(read(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'"), "l_quantity", "l_extendedprice"), "corr")


# --- regressions ---------------------------------------------------------


def ols_simple(spark, sf_dir):
    fit = regression.ols(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity"])
    return spark.createDataFrame([(round(float(fit.coef[0]), 4), round(float(fit.coef[1]), 6), round(fit.r2, 6), int(fit.n))], "intercept double, slope double, r2 double, n long")


def _coefficients(spark, fit) -> DataFrame:
    return spark.createDataFrame([(n, round(b, 4), round(se, 4), round(b / se, 4)) for n, b, se, _ in fit.table()], "name string, coef double, se double, t double")


def ols_multi_hc1(spark, sf_dir):
    return _coefficients(spark, regression.ols(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], robust=True))


def joint_nulls(spark, sf_dir):
    """Rows that lack any of the columns count for nothing."""
    price = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice"))
    rate = F.when(F.col("l_linenumber") == 5, float("nan")).otherwise(F.col("l_discount"))
    fit = regression.ols(read(spark, sf_dir, "lineitem").select(price.alias("y"), rate.alias("x")), "y", ["x"])
    return spark.createDataFrame([(round(float(fit.coef[1]), 4), int(fit.n))], "slope double, n long")


def iv_single(spark, sf_dir):
    fit = regression.two_stage(_lines(spark, sf_dir), "y", "kappa", [], ["z1"])
    return spark.createDataFrame([(round(fit.of("kappa")[0], 4), int(fit.n))], "slope double, n long")


def _lines(spark, sf_dir):
    """Lines with an endogenous regressor ``kappa`` and instruments, one of them the sum of two others."""
    lines = read(spark, sf_dir, "lineitem")
    noise = F.conv(F.substring(F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return lines.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("z1"), (F.col("l_partkey") % 7).cast("double").alias("z2"), (F.col("l_quantity") + F.col("l_partkey") % 7).alias("z3"), F.col("l_discount"), F.col("l_tax"), (F.col("l_quantity") + 20 * noise).alias("kappa"), (F.col("l_extendedprice") / 1000 + 30 * noise).alias("y"))


CONTROLS, INSTRUMENTS = ["l_discount", "l_tax"], ["z1", "z2", "z3"]


def iv_2sls(spark, sf_dir):
    return _coefficients(spark, regression.two_stage(_lines(spark, sf_dir), "y", "kappa", CONTROLS, INSTRUMENTS))


def first_stage(spark, sf_dir):
    info = regression.two_stage(_lines(spark, sf_dir), "y", "kappa", CONTROLS, INSTRUMENTS).info
    return spark.createDataFrame([(k, round(float(info[k]), 4)) for k in ("f", "wald", "partial_r2", "rank", "q", "strong")], "name string, value double")


def hausman(spark, sf_dir):
    m = gram(_lines(spark, sf_dir), [*CONTROLS, "kappa", *INSTRUMENTS, "y"])
    out = [(name, regression.hausman_of(m, "y", "kappa", CONTROLS, INSTRUMENTS, corrected=c)[0]) for name, c in (("fitted", False), ("corrected", True))]
    return spark.createDataFrame([(n, None if h is None else round(float(h), 4)) for n, h in out], "variant string, h double")


BATTERY = Settings(controls=("l_discount", "l_tax"), instruments=("z1", "z2", "z3"), bootstrap=0, placebo=0)


def stage2(spark, sf_dir):
    """The battery of the second stage but for its resampling, which has queries of its own."""
    rows = _lines(spark, sf_dir).select(F.col("y").alias("pass_rate"), F.col("kappa").alias("kappa_actual"), F.col("z1").alias("kappa_predicted"), "l_discount", "l_tax", "z1", "z2", "z3")
    out = stages.stage2(rows, BATTERY)
    coef = lambda fit: (fit.of("kappa_actual")[0], fit.of("kappa_actual")[1] ** 0.5)
    (b0, s0), (b1, s1), info, found = coef(out["naive"]), coef(out["iv"]), out["iv"].info, out["search"]
    facts = {"naive_coef": b0, "naive_se": s0, "iv_coef": b1, "iv_se": s1, "first_stage_f": info["f"], "wald": info["wald"], "hausman": out["facts"]["hausman"], "gamma": found.gamma, "sup_f": found.sup}
    return spark.createDataFrame([(k, None if v is None else round(float(v), 4)) for k, v in facts.items()], "name string, value double")


# --- threshold -----------------------------------------------------------


def _search(spark, sf_dir, controls=(), rows=None) -> threshold.Search:
    lines = read(spark, sf_dir, "lineitem") if rows is None else rows
    return threshold.search(lines, "l_extendedprice", "l_quantity", list(controls))


def threshold_curve(spark, sf_dir):
    return rounded(_search(spark, sf_dir).frame(spark), "f_stat")


CURVE_IN_SQL = """SELECT gamma, round(f_stat, 6) AS f_stat FROM threshold_f(TABLE (
  SELECT threshold_cell(x) AS cell, count(*) AS n, avg(x) AS mean_x, avg(y) AS mean_y, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy
  FROM (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM parquet.`{folder}/lineitem.parquet`)
  WHERE x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y) GROUP BY ALL) WITH SINGLE PARTITION)"""


def threshold_sql(spark, sf_dir):
    """The curve by SQL alone: cells and their moments are aggregated by Spark, one row per cell reaches the function."""
    sql_surface.register(spark)
    return spark.sql(CURVE_IN_SQL.format(folder=sf_dir))


def threshold_best(spark, sf_dir):
    return summary.top(threshold_curve(spark, sf_dir).filter("f_stat is not null"), "f_stat", "gamma")


def threshold_controls(spark, sf_dir):
    return rounded(_search(spark, sf_dir, ("l_discount", "l_tax")).frame(spark), "f_stat")


def stream_curve(spark, sf_dir):
    """The curve of a stream of the orders that sends each of them twice."""
    schema = read(spark, sf_dir, "orders").schema
    orders = lambda: spark.readStream.schema(schema).parquet(f"{sf_dir}/order[s].parquet")  # noqa: E731  streams take a pattern or a folder, no single file
    rows = orders().unionByName(orders()).select("o_orderkey", "o_orderdate", (F.col("o_orderkey") % 17 + 0.25).alias("kappa"), (F.col("o_totalprice") / 1000).alias("y"))
    target = f"{scratch.folder(spark)}/stream-{uuid.uuid4().hex}"
    curve_stream.start(rows, "y", "kappa", [], "o_orderkey", "o_orderdate", f"{target}/curves", f"{target}/state", delay="20000 days", shift={"kappa": 8.0, "y": 150.0}).awaitTermination()
    return rounded(curve_stream.latest(spark, f"{target}/curves"), "f_stat")


def figure_threshold(spark, sf_dir):
    g = threshold.figure_threshold(read(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ["l_discount"])
    return spark.createDataFrame([(g,)], "gamma double")


def wild_bootstrap(spark, sf_dir):
    found = threshold.search(_orders(spark, sf_dir), "y", "kappa", [])
    return rounded(threshold.draws_frame(spark, threshold.wild_bootstrap(found, F.col("key"), 5)), "sup_f")


def _orders(spark, sf_dir):
    """Orders, whose key is unique: complexity from the key, outcome from the price."""
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderkey") % 17 + 0.25).alias("kappa"), (F.col("o_totalprice") / 1000).alias("y"))


def placebo(spark, sf_dir):
    found = threshold.search(_orders(spark, sf_dir), "y", "kappa", [])
    return rounded(threshold.draws_frame(spark, threshold.placebo(found, F.col("key"), 5)), "sup_f")


def resampling_report(spark, sf_dir):
    found = threshold.search(_orders(spark, sf_dir), "y", "kappa", [])
    p = threshold.share_at_least(threshold.wild_bootstrap(found, F.col("key"), 20), found.sup)
    fake = threshold.compare(found, threshold.placebo(found, F.col("key"), 20))
    return spark.createDataFrame([(found.gamma, round(found.sup, 6), p, threshold.verdict(p), round(fake["z"], 6), fake["p"], fake["verdict"])], "gamma double, sup_f double, p double, significance string, z double, placebo_p double, verdict string")


def resampling_500(spark, sf_dir):
    """Both resamplings with all their draws: their number and their means."""
    found = threshold.search(_orders(spark, sf_dir), "y", "kappa", [])
    rows = [("bootstrap", threshold.wild_bootstrap(found, F.col("key"), Settings().bootstrap)), ("placebo", threshold.placebo(found, F.col("key"), Settings().placebo))]
    return spark.createDataFrame([(name, len(draws), round(sum(s for _, s, _ in draws) / len(draws), 6)) for name, draws in rows], "kind string, n long, mean_sup double")


def draw_report(spark, sf_dir):
    return rounded(summary.draw_report(read(spark, sf_dir, "lineitem"), "l_extendedprice"), "mean", "sd", "median", "p05", "p95")


# --- samples, folds, forest, similarity ----------------------------------


def exact_sample(spark, sf_dir):
    return tasks.exact_sample(read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100)


def exact_sample_half(spark, sf_dir):
    """Half of a table, which no task holds or sorts."""
    rows = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return tasks.exact_sample(rows, "o_orderkey", rows.count() // 2)


def kfold_sizes(spark, sf_dir):
    rows = forest.folds(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 10)
    return rows.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


def cv_metrics(spark, sf_dir):
    rows = forest.folds(read(spark, sf_dir, "orders"), "o_orderkey", 10).select("fold", (F.col("o_totalprice") / 1000).alias("y"), (F.col("o_custkey") / 10.0).alias("p"))
    return rounded(summary.cv_report(rows, "y", "p"), "mean_r2", "sd_r2", "min_r2", "max_r2", "mean_mae", "oof_r2")


FOREST_FEATURES = ["inst_tokens", "inst_if_count", "inst_loop_count", "inst_class_count"]


def _forest_rows(spark, sf_dir):
    """Labelled documents: coarse counts, of few values each, as features and the length as what they predict."""
    rows = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("doc_id", "n_chars", "quality", text.instruction_features(F.col("text"), FIXTURE_LEXICON).alias("f"))
    coarse = [F.least(F.floor(F.col(f"f.{c}") / (25 if c == "inst_tokens" else 2)), F.lit(40)).cast("long").alias(c) for c in FOREST_FEATURES]
    return rows.select(F.col("doc_id").cast("long").alias("id"), *coarse, F.col("n_chars").cast("long").alias("kappa_actual"), F.col("quality").cast("long").alias("is_success"))


TREE = Settings(trees=1, depth=3, folds=3, resample_rows=False)


def forest_oof(spark, sf_dir):
    """Predictions of all rows by the model of the successes, and held out ones, of single trees."""
    out = forest.train(_forest_rows(spark, sf_dir), FOREST_FEATURES, settings=TREE)
    return rounded(out.scored.select("id", "kappa_predicted", "kappa_predicted_oof"), "kappa_predicted", "kappa_predicted_oof")


def forest_importance(spark, sf_dir):
    return rounded(forest.train(_forest_rows(spark, sf_dir), FOREST_FEATURES, settings=TREE).importances, "importance")


def forest_sensitivity(spark, sf_dir):
    """Scores of the folds over all rows, and the correlation of both models on the failures."""
    rows = _forest_rows(spark, sf_dir).persist()  # the texts are read once for both
    out = forest.train(rows, FOREST_FEATURES, settings=TREE)
    scores, corr = forest.sensitivity(rows, out.model, FOREST_FEATURES, settings=TREE)
    out.release()
    rows.unpersist()
    both = scores.crossJoin(corr)  # one row each
    return rounded(both, *both.columns)


def forest_full(spark, sf_dir):
    """All trees and folds: every row's prediction and held-out prediction."""
    return forest.train(_forest_rows(spark, sf_dir), FOREST_FEATURES).scored.select("id", "kappa_actual", "is_success", "kappa_predicted", "kappa_predicted_oof")


def tfidf_max_cosine(spark, sf_dir):
    out = similarity.max_similarity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")
    return rounded(out, "similarity")


def tfidf_joined(spark, sf_dir):
    """The same cosines by the joins that a corpus of any size takes; terms of over 8 items make no pairs."""
    out = similarity.max_similarity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", terms=0, hot=8)
    return rounded(out, "similarity")


def ast_metrics(spark, sf_dir):
    """Python made from the size of parts: functions, classes and branches one after another."""
    many = lambda code, n: F.repeat(F.lit(code), (F.col("p_size") % n).cast("int"))
    code = F.concat(many("def f():\n    return 1\n", 3), many("class A:\n    pass\n", 2), many("if a and b:\n    x = [i for i in y]\n", 5))
    lang = F.when(F.col("p_partkey") % 4 == 0, "java").otherwise("python")
    rows = scratch.spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", code_metrics.gated_code_metrics(code, lang).alias("g"), code_metrics.code_metrics(code).alias("m"))
    return whole(rows.select("p_partkey", F.col("g.ast_cyclomatic").alias("gated"), "m.ast_cyclomatic", "m.ast_nesting_depth", "m.ast_function_count", "m.ast_class_count"), "gated", "ast_cyclomatic", "ast_nesting_depth", "ast_function_count", "ast_class_count")


def ast_recovered(spark, sf_dir):
    """Code with planted errors: open and stray brackets, missing colons, lines that are no statement."""
    many = lambda code, n: F.repeat(F.lit(code), (F.col("p_size") % n).cast("int"))
    code = F.concat(
        many("def f(:\n    return 1\n", 3), many("class A\n    pass\n", 2), many("if a and b\n    x = [i for i in y]\n", 5), F.lit("x = = 1\n"),
        many("while c:\n    try:\n        d = )\n    except E:\n        pass\n", 4), F.lit("z = (1,\n"),
    )
    rows = scratch.spread(read(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", code_metrics.code_metrics(code).alias("m")).select("p_partkey", "m.*")
    return whole(rows, *rows.columns[1:])


def _records(spark, sf_dir) -> DataFrame:
    """Scored records, one for each conversation: all its turns, "user" turns as passed checks, a
    line of code for each turn, and members that only some records have."""
    turns = read(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "PASSED").otherwise(F.col("role"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"), F.collect_list(role).alias("status"), F.count("*").alias("n"))
    some = lambda at, value: F.when(F.col("conv_id") % at != 0, value)  # noqa: E731  a null member is left out
    member = F.struct(
        F.col("conv_id").cast("string").alias("id"), F.array_join("t.text", " ").alias("input"), some(7, F.col("status")).alias("status"), some(2, F.lit("python")).alias("lang"),
        F.repeat(F.lit("x = 1 if y else 2\n"), F.col("n").cast("int")).alias("code_cleaned"), some(3, F.col("n").cast("double")).alias("kappa_cyclomatic"), some(5, F.col("n") / 8).alias("e_norm"), F.lit(3).alias("extra"),
    )
    return rows.select(F.parse_json(F.to_json(member)).alias("record"))


def enrich_records(spark, sf_dir):
    """The whole extractor; members are read back from the objects that it writes."""
    out = enrich(_records(spark, sf_dir)).select(F.parse_json("json").alias("j"))
    get = lambda path, kind: F.try_variant_get("j", f"$.{path}", kind).alias(path.split(".")[-1])
    return out.select(get("id", "string"), r6(get("pass_rate", "double")).alias("pass_rate"), get("is_success", "long"), get("iv_features.inst_tokens", "long"), get("iv_features.inst_class_count", "long"), get("iv_features.inst_collection_count", "long"), get("ast_features.ast_cyclomatic", "long"), get("kappa_cyclomatic", "double"), get("e_norm", "double"), get("coupling_depth", "long"), get("extra", "long"))


def load_records(spark, sf_dir):
    """Enriched lines written, read and flattened by the loads of both stages and of the figures."""
    path = tasks.write_temporary(enrich(_records(spark, sf_dir)).select(F.col("json").alias("value")))
    one = tasks.load_stage1(spark, path).select("id", "inst_tokens", "inst_collection_count", "kappa_actual", "is_success", "lang", "e_norm", "m_mem_jaccard", "coupling_depth", r6("pass_rate").alias("pass_rate"))
    two = tasks.load_interactive_figures(spark, path).select("id", r6("pass_rate").alias("figure_rate"))
    three = tasks.load_static_figures(spark, path).select("id", F.col("e_norm").alias("figure_e"))
    return whole(one.join(two, "id").join(three, "id"), "inst_tokens", "inst_collection_count", "is_success", "coupling_depth")


WORDS = "[^\\p{L}\\p{N}_]+"


def _hits(words: tuple[str, ...], column: str = "text") -> str:
    """Whole-word matches in SQL; of two words in a row, their pairs."""
    parts = f"regexp_split_to_array(lower({column}), '{WORDS}')"
    single = [w for w in words if " " not in w]
    out = [f"len(list_filter({parts}, lambda x: x IN ({', '.join(repr(w) for w in single)})))"] if single else []
    for w in words:
        if " " in w:
            out.append(f"len(regexp_extract_all(lower({column}), '(^|{WORDS[:-1]}){w}($|{WORDS[:-1]})'))")
    return "(" + " + ".join(out) + ")"


def _features_sql() -> str:
    n = {k: _hits(v) for k, v in FIXTURE_LEXICON.items()}
    counts = ", ".join(f"{n[k]}::BIGINT AS inst_{k}_count" for k in n)
    return f"""SELECT doc_id, len(regexp_extract_all(text, '\\S+'))::BIGINT AS inst_tokens, {counts},
      ({n['if']} + {n['loop']} + {n['class']} + {n['func']})::BIGINT AS inst_total_structural,
      round(CASE WHEN len(regexp_extract_all(text, '\\S+')) > 0 THEN length(regexp_replace(text, '\\s', '', 'g')) / len(regexp_extract_all(text, '\\S+')) ELSE 0 END, 6) AS inst_avg_word_len FROM documents"""


def _edges_sql(column: str, table: str, bins: int, to: str) -> str:
    """Right-closed equal-width bin as a scalar expression over the columns lo_ and hi_."""
    return f"""(SELECT count(*) FROM range(0, {bins + 1}) e(i) WHERE CASE WHEN i = 0 THEN lo_{to} - 0.001::DOUBLE * (hi_{to} - lo_{to}) WHEN i = {bins} THEN hi_{to} ELSE lo_{to} + i * ((hi_{to} - lo_{to}) / {bins}) END < {column})"""


def _range_sql(column: str, table: str, to: str) -> str:
    return f"(SELECT min({column}) AS lo_{to}, max({column}) AS hi_{to} FROM {table})"


def _cut_sql(column: str, edges: list[float]) -> str:
    inner = " ".join(f"WHEN {column} <= {e} THEN {i}" for i, e in enumerate(edges[1:], 1))
    return f"CASE WHEN {column} <= {edges[0]} THEN NULL {inner} END"


FLOW_SQL = f"""WITH b AS (SELECT {_cut_sql('l_quantity / 2', summary.PRED_EDGES)}::BIGINT AS pred_bin, {_cut_sql('(l_tax * 100 + 1)', summary.OBS_EDGES)}::BIGINT AS obs_bin FROM lineitem),
f AS (SELECT pred_bin, obs_bin, count(*) AS "count" FROM b WHERE pred_bin IS NOT NULL AND obs_bin IS NOT NULL GROUP BY ALL HAVING count(*) > 50)
SELECT *, (obs_bin = 1 AND pred_bin <> 1)::BIGINT AS wrong FROM f"""


def _phase_sql(k: int, e: int) -> str:
    return f"""SELECT {_edges_sql('l_quantity', 'lineitem', k, 'k')}::BIGINT AS k_bin, {_edges_sql('l_extendedprice', 'lineitem', e, 'e')}::BIGINT AS e_bin, avg(l_discount) AS m
      FROM lineitem, {_range_sql('l_quantity', 'lineitem', 'k')}, {_range_sql('l_extendedprice', 'lineitem', 'e')} GROUP BY ALL"""


def _ssr(y: str, x: str, where: str) -> str:
    return f"(regr_syy({y}, {x}) FILTER ({where}) - coalesce(regr_sxy({y}, {x}) FILTER ({where}) ** 2 / nullif(regr_sxx({y}, {x}) FILTER ({where}), 0), 0))"


def _curve_sql(source: str, y: str, x: str, group: str = "") -> str:
    """F statistic per grid point without controls (k = 2)."""
    by = f"{group}, " if group else ""
    return f"""WITH g AS (SELECT (2.0 + 0.5 * i)::DOUBLE AS gamma FROM range(26) r(i)), t AS ({source}),
a AS (SELECT {by}gamma, count(*) AS n, count(*) FILTER ({x} <= gamma) AS nl, count(*) FILTER ({x} > gamma) AS nh, {_ssr(y, x, 'true')} AS s, {_ssr(y, x, f'{x} <= gamma')} AS sl, {_ssr(y, x, f'{x} > gamma')} AS sh FROM t, g GROUP BY {by}gamma),
c AS (SELECT {by}gamma, CASE WHEN nl >= 100 AND nh >= 100 THEN ((s - sl - sh) / 2) / ((sl + sh) / (n - 4)) END AS f FROM a)"""


ORDERS = "SELECT o_orderkey AS key, o_orderkey % 17 + 0.25::DOUBLE AS x, o_totalprice / 1000 AS y FROM orders"


def _boot_sql(draws: int) -> str:
    digit = f"('0x' || substr(md5(key::VARCHAR || '-' || ((iter - 1) // {threshold.BLOCK})::VARCHAR), (1 + ((iter - 1) % {threshold.BLOCK}) // 4)::INT, 1))::UBIGINT::INT"
    return f"""WITH o AS ({ORDERS}), b AS (SELECT regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM o)
  SELECT iter, x, b0 + b1 * x + (y - b0 - b1 * x) * CASE WHEN ({digit} >> (3 - (iter - 1) % 4)::INT) & 1 = 0 THEN 1 ELSE -1 END AS y FROM o, b, range(1, {draws + 1}) i(iter)"""


def _walk_sql(source: str) -> str:
    """One pass of a draw's rounds over the places ``v``."""
    out = f"SELECT iter, place, v // b AS l, v % b AS r, n, a, b, ks FROM {source}"
    for i in range(threshold.ROUNDS):
        own, other, size = ("r", "l", "b") if i % 2 else ("l", "r", "a")
        more = f"((({other} * {other} % {threshold.PRIME}) * ks[{3 * i + 1}] + {other} * ks[{3 * i + 2}] + ks[{3 * i + 3}]) % {threshold.PRIME})"
        out = f"SELECT iter, place, n, a, b, ks, {other}, ({own} + {more}) % {size} AS {own} FROM ({out})"
    return f"SELECT iter, place, l * b + r AS v, n, a, b, ks FROM ({out})"


def _placebo_sql(draws: int) -> str:
    return f"""WITH RECURSIVE o AS ({ORDERS}), r AS MATERIALIZED (SELECT x, y, row_number() OVER (ORDER BY md5(key::VARCHAR || '-0')) - 1 AS place FROM o),
  d AS (SELECT n, a, ceil(n / a)::BIGINT AS b FROM (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM o)),
  k AS (SELECT iter, list_transform(range({3 * threshold.ROUNDS}), lambda j: ('0x' || substr(md5(iter::VARCHAR || '-' || (j // 3)::VARCHAR), (1 + 7 * (j % 3))::INT, 7))::UBIGINT::BIGINT) AS ks FROM range(1, {draws + 1}) i(iter)),
  s AS ({_walk_sql('(SELECT iter, place, place AS v, n, a, b, ks FROM r, d, k)')} UNION ALL {_walk_sql('(SELECT * FROM s WHERE v >= n)')})
  SELECT s.iter, q.x AS x, p.y AS y FROM s JOIN r p USING (place) JOIN r q ON q.place = s.v WHERE s.v < s.n"""


SUP = "SELECT iter::INT AS iter, round(max(f), 6) AS sup_f, arg_max(gamma, round(f, 9) - gamma * 1e-12) AS gamma FROM c WHERE f IS NOT NULL GROUP BY iter"
FOLDS = "SELECT *, (row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '-42')) - 1) % 10 AS fold FROM orders"


def _grams_sql(table: str, key: str) -> str:
    return f"""SELECT {key} AS id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term
      FROM (SELECT {key}, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2) AS w FROM {table})"""


TFIDF_SQL = f"""WITH q AS (SELECT id, term, count(*) AS tf FROM ({_grams_sql('documents', 'doc_id')}) GROUP BY ALL), p AS (SELECT id, term, count(*) AS tf FROM ({_grams_sql('benchmark', 'item_id')}) GROUP BY ALL),
n AS (SELECT count(*) + 2.0::DOUBLE AS n FROM benchmark), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
s AS (SELECT q.*, f.df, ln(n / (coalesce(f.df, 0) + 2.0::DOUBLE)) + 1 AS i1 FROM q LEFT JOIN f USING (term), n), na AS (SELECT id, sum((tf * i1) ** 2) AS na FROM s GROUP BY id),
t AS (SELECT p.*, ln(n / (f.df + 1.0::DOUBLE)) + 1 AS i0 FROM p JOIN f USING (term), n), nb AS (SELECT id, sum((tf * i0) ** 2) AS nb FROM t GROUP BY id),
d AS (SELECT s.id AS a, t.id AS b, sum(s.tf * t.tf * i1 ** 2) AS dot, sum(t.tf ** 2 * (i1 ** 2 - i0 ** 2)) AS fix FROM s JOIN t USING (term) GROUP BY ALL),
m AS (SELECT a, max(dot / sqrt(na * (nb + fix))) AS s FROM d JOIN na ON na.id = a JOIN nb ON nb.id = b GROUP BY a)
SELECT doc_id, round(coalesce(s, 0), 6) AS similarity FROM documents LEFT JOIN m ON a = doc_id"""

def _drop(rows: str, k: int, last: int, by: str) -> str:
    """Eliminates columns 0 .. ``k`` - 1 of the symmetric matrices ``a_i_j`` of a table, one a step;
    what is left of the others is what the eliminated ones do not explain."""
    out = rows
    for p in range(k):
        left = [f"a_{i}_{j} - a_{p}_{i} * a_{p}_{j} / a_{p}_{p} AS a_{i}_{j}" for i in range(p + 1, last + 1) for j in range(i, last + 1)]
        out = f"SELECT {by}{', '.join(left)} FROM ({out})"
    return out


def _gram_sql(columns: list[str], where: str = "true", name: str = "a") -> str:
    return ", ".join(f"sum({x} * {y}) FILTER ({where}) AS {name}_{i}_{j}" for i, x in enumerate(columns) for j, y in enumerate(columns) if j >= i)


def _inverse_sql(source: str, k: int, keep: str) -> str:
    """``v_i_j``: the inverses of the symmetric k x k matrices ``a_i_j``, by Gauss-Jordan steps."""
    at = lambda i, j: f"a_{min(i, j)}_{max(i, j)}"
    out = f"SELECT {keep}{', '.join([f'{at(i, j)} AS m_{i}_{j}' for i in range(k) for j in range(k)] + [f'{float(i == j)}::DOUBLE AS v_{i}_{j}' for i in range(k) for j in range(k)])} FROM ({source})"
    for p in range(k):
        rows = [f"{c}_{i}_{j} - m_{i}_{p} * {c}_{p}_{j} / m_{p}_{p} AS {c}_{i}_{j}" if i != p else f"{c}_{p}_{j} / m_{p}_{p} AS {c}_{p}_{j}" for c in "mv" for i in range(k) for j in range(k)]
        out = f"SELECT {keep}{', '.join(rows)} FROM ({out})"
    return out


def _total(parts) -> str:
    return "(" + " + ".join(parts) + ")"


def _sandwich(k: int, i: int) -> str:
    s = lambda p, q: f"s_{min(p, q)}_{max(p, q)}"
    return _total(f"v_{i}_{p} * {s(p, q)} * v_{q}_{i}" for p in range(k) for q in range(k))


def _table_sql(names: list[str], scale: str) -> str:
    k = len(names)
    return " UNION ALL ".join(f"SELECT '{n}' AS name, round(b_{i}, 4) AS coef, round(sqrt({scale} * {_sandwich(k, i)}), 4) AS se, round(b_{i} / sqrt({scale} * {_sandwich(k, i)}), 4) AS t FROM f" for i, n in enumerate(names))


def _ols_sql(source: str, x: list[str], y: str, names: list[str]) -> str:
    k = len(x)
    keep = "n, " + ", ".join(f"y_{i}" for i in range(k)) + ", "
    b = ", ".join(f"{_total(f'v_{i}_{j} * y_{j}' for j in range(k))} AS b_{i}" for i in range(k))
    e = f"({y} - {_total(f'b_{i} * {c}' for i, c in enumerate(x))})"
    return f"""WITH t AS ({source}), g AS (SELECT count(*) AS n, {', '.join(f'sum({c} * {y}) AS y_{i}' for i, c in enumerate(x))}, {_gram_sql(x)} FROM t),
i AS MATERIALIZED (SELECT *, {b} FROM ({_inverse_sql('SELECT * FROM g', k, keep)})),
m AS (SELECT {', '.join(f'sum({e} ** 2 * {p} * {q}) AS s_{i}_{j}' for i, p in enumerate(x) for j, q in enumerate(x) if j >= i)} FROM t, i), f AS MATERIALIZED (SELECT * FROM i, m)
{_table_sql(names, f'(n / (n - {k}))')}"""


LINES = """SELECT 1.0::DOUBLE AS one, l_discount AS w1, l_tax AS w2, l_quantity AS z1, (l_partkey % 7)::DOUBLE AS z2, l_quantity + 20 * e AS k, l_extendedprice / 1000 + 30 * e AS y
FROM (SELECT *, ('0x' || substr(md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS e FROM lineitem)"""


def _iv_sql() -> str:
    """CTEs of two-stage least squares without the third, collinear instrument: ``z`` has the inverse of
    Z'Z and cross sums, ``h`` the first-stage coefficients ``p_z_x`` and ``b``, ``f`` the middle of the sandwich."""
    z, x = ["one", "w1", "w2", "z1", "z2"], ["one", "w1", "w2", "k"]
    cross = [f"sum({c} * {d}) AS c_{i}_{j}" for i, c in enumerate(z) for j, d in enumerate(x)] + [f"sum({c} * y) AS y_{i}" for i, c in enumerate(z)]
    names = [f"c_{i}_{j}" for i in range(5) for j in range(4)] + [f"y_{i}" for i in range(5)]
    keep = "n, kk, yy, " + ", ".join(names) + ", "
    pi = [f"{_total(f'v_{i}_{p} * c_{p}_{j}' for p in range(5))} AS p_{i}_{j}" for i in range(5) for j in range(4)]
    hat = [f"{_total(f'c_{p}_{i} * p_{p}_{j}' for p in range(5))} AS a_{i}_{j}" for i in range(4) for j in range(i, 4)] + [f"{_total(f'p_{p}_{i} * y_{p}' for p in range(5))} AS r_{i}" for i in range(4)]
    keep2 = "n, yy, " + ", ".join(f"p_{i}_{j}" for i in range(5) for j in range(4)) + ", " + ", ".join(f"r_{i}" for i in range(4)) + ", "
    b = ", ".join(f"{_total(f'v_{i}_{j} * r_{j}' for j in range(4))} AS b_{i}" for i in range(4))
    e = f"(y - {_total(f'b_{i} * {c}' for i, c in enumerate(x))})"
    fitted = [_total(f"p_{p}_{i} * {c}" for p, c in enumerate(z)) for i in range(4)]
    return f"""t AS MATERIALIZED ({LINES}), g AS (SELECT count(*) AS n, sum(k * k) AS kk, sum(y * y) AS yy, {', '.join(cross)}, {_gram_sql(z)} FROM t),
z AS MATERIALIZED (SELECT *, {', '.join(pi)} FROM ({_inverse_sql('SELECT * FROM g', 5, keep)})),
h AS MATERIALIZED (SELECT *, {b} FROM ({_inverse_sql(f'SELECT *, {", ".join(hat)} FROM z', 4, keep2)})),
m AS (SELECT sum({e} ** 2) AS rss, {', '.join(f'sum({e} ** 2 * {fitted[i]} * {fitted[j]}) AS s_{i}_{j}' for i in range(4) for j in range(i, 4))} FROM t, h), f AS MATERIALIZED (SELECT * FROM h, m)"""


def _first_stage_sql() -> str:
    z = ["one", "w1", "w2", "z1", "z2"]
    u = f"(k - {_total(f'p_{i}_3 * {c}' for i, c in enumerate(z))})"
    s = lambda p, q: f"s_{min(p, q)}_{max(p, q)}"
    v = {(i, j): _total(f"v_{i}_{p} * {s(p, q)} * v_{q}_{j}" for p in range(5) for q in range(5)) for i in (3, 4) for j in (3, 4)}
    return f"""WITH {_iv_sql()}, short AS ({_drop('SELECT ' + _gram_sql(['one', 'w1', 'w2', 'k']) + ' FROM t', 3, 3, '')}),
u AS (SELECT sum({u} ** 2) AS rss1, {', '.join(f'sum({u} ** 2 * {z[i]} * {z[j]}) AS s_{i}_{j}' for i in range(5) for j in range(i, 5))} FROM t, z),
w AS (SELECT n, rss1, a_3_3 AS rss0, p_3_3 AS p3, p_4_3 AS p4, {v[3, 3]} AS v33, {v[3, 4]} AS v34, {v[4, 4]} AS v44 FROM z, u, short),
r AS (SELECT (rss0 - rss1) / 2 / (rss1 / (n - 5)) AS f, (p3 * p3 * v44 - 2 * p3 * p4 * v34 + p4 * p4 * v33) / (v33 * v44 - v34 * v34) AS wald, (rss0 - rss1) / rss0 AS partial_r2 FROM w)
SELECT 'f' AS name, round(f, 4) AS value FROM r UNION ALL SELECT 'wald', round(wald, 4) FROM r UNION ALL SELECT 'partial_r2', round(partial_r2, 4) FROM r
UNION ALL SELECT 'rank', 5.0 UNION ALL SELECT 'q', 2.0 UNION ALL SELECT 'strong', (f > 10)::INT::DOUBLE FROM r"""


def _hausman_sql() -> str:
    x = ["one", "w1", "w2", "k"]
    keep = ", ".join(f"y_{i}" for i in range(4)) + ", n, yy, "
    own = f"SELECT count(*) AS n, sum(y * y) AS yy, {', '.join(f'sum({c} * y) AS y_{i}' for i, c in enumerate(x))}, {_gram_sql(x)} FROM t"
    b = lambda i: _total(f"v_{i}_{j} * y_{j}" for j in range(4))
    return f"""WITH {_iv_sql()}, o AS (SELECT {b(3)} AS b1, v_3_3 * (yy - {_total(f'{b(i)} * y_{i}' for i in range(4))}) / (n - 4) AS v1 FROM ({_inverse_sql(own, 4, keep)})),
d AS (SELECT 'fitted' AS variant, yy - {_total(f'b_{i} * r_{i}' for i in range(4))} AS rss2 FROM f UNION ALL SELECT 'corrected', rss FROM f)
SELECT variant, CASE WHEN v_3_3 * rss2 / (n - 4) > v1 THEN round((b_3 - b1) ** 2 / (v_3_3 * rss2 / (n - 4) - v1), 4) END AS h FROM d, f, o"""


def _wide_curve_sql(x: str, controls: list[str], y: str, table: str) -> str:
    """F statistic per grid point with controls: what elimination leaves of y'y is the residual sum."""
    columns = ["one", x, *controls, y]
    k = len(columns) - 1
    side = lambda where, name: f"SELECT gamma, '{name}' AS side, count(*) FILTER ({where}) AS n, {_gram_sql(columns, where)} FROM (SELECT *, 1.0::DOUBLE AS one FROM {table}), g GROUP BY gamma"
    every = " UNION ALL ".join(side(w, n) for w, n in (("true", "all"), (f"{x} <= gamma", "low"), (f"{x} > gamma", "high")))
    return f"""WITH g AS (SELECT (2.0 + 0.5 * i)::DOUBLE AS gamma FROM range(26) r(i)), e AS ({_drop(every, k, k, 'gamma, side, n, ')}),
c AS (SELECT gamma, max(n) FILTER (side = 'all') AS n, min(n) AS least, max(a_{k}_{k}) FILTER (side = 'all') AS s, sum(a_{k}_{k}) FILTER (side <> 'all') AS parts FROM e GROUP BY gamma),
f AS (SELECT gamma, CASE WHEN least >= 100 THEN ((s - parts) / {k}) / (parts / (n - {2 * k})) END AS f FROM c)"""


def _resampling_sql() -> str:
    best = f"({_curve_sql(ORDERS, 'y', 'x')} SELECT gamma, f FROM c WHERE f IS NOT NULL ORDER BY round(f, 9) DESC, gamma LIMIT 1)"
    draws = lambda source: f"({_curve_sql(source, 'y', 'x', 'iter')} SELECT iter, max(f) AS f, arg_max(gamma, round(f, 9) - gamma * 1e-12) AS gamma FROM c WHERE f IS NOT NULL GROUP BY iter)"
    words = "CASE WHEN p < 0.01 THEN 'significant at 1%' WHEN p < 0.05 THEN 'significant at 5%' WHEN p < 0.1 THEN 'significant at 10%' ELSE 'not significant' END"
    return f"""WITH best AS {best}, boot AS (SELECT avg((d.f >= best.f)::INT) AS p FROM {draws(_boot_sql(20))} d, best),
fake AS (SELECT avg(d.gamma) AS m, stddev_pop(d.gamma) AS sd, avg((d.f >= best.f)::INT) AS q FROM {draws(_placebo_sql(20))} d, best)
SELECT gamma, round(f, 6) AS sup_f, p, {words} AS significance, round((gamma - m) / sd, 6) AS z, q AS placebo_p, CASE WHEN q < 0.05 THEN 'real' ELSE 'may be spurious' END AS verdict FROM best, boot, fake"""


def _resampling_500_sql() -> str:
    draws = lambda kind, source: f"SELECT '{kind}' AS kind, count(*) AS n, round(avg(f), 6) AS mean_sup FROM ({_curve_sql(source, 'y', 'x', 'iter')} SELECT iter, max(f) AS f FROM c WHERE f IS NOT NULL GROUP BY iter)"
    return draws("bootstrap", _boot_sql(Settings().bootstrap)) + " UNION ALL " + draws("placebo", _placebo_sql(Settings().placebo))


def _stage2_sql() -> str:
    naive = f"({_ols_sql(LINES, ['one', 'k', 'w1', 'w2'], 'y', ['const', 'kappa', 'l_discount', 'l_tax'])})"
    iv = f"(WITH {_iv_sql()} {_table_sql(['const', 'l_discount', 'l_tax', 'kappa'], '1.0')})"
    best = f"({_wide_curve_sql('z1', ['w1', 'w2'], 'y', f'(SELECT z1, w1, w2, y FROM ({LINES}))')} SELECT gamma, f FROM f WHERE f IS NOT NULL ORDER BY round(f, 9) DESC, gamma LIMIT 1)"
    one = lambda name, value, source, where="true": f"SELECT '{name}' AS name, {value} AS value FROM {source} WHERE {where}"
    rows = [one(f"{kind}_{v}", v, source, "name = 'kappa'") for kind, source in (("naive", naive), ("iv", iv)) for v in ("coef", "se")]
    rows += [one(to, "value", f"({_first_stage_sql()})", f"name = '{name}'") for to, name in (("first_stage_f", "f"), ("wald", "wald"))]
    rows += [one("hausman", "h", f"({_hausman_sql()})", "variant = 'fitted'"), one("gamma", "gamma", best), one("sup_f", "round(f, 4)", best)]
    return " UNION ALL ".join(rows)


def _tree_sql(which: str) -> str:
    """CTEs of regression trees of depth 3: ``pred`` has the prediction ``p`` of every row by each model ``m``,
    ``splits`` the chosen splits with their gains.  Model -1 sees all rows of ``which``, -2 those of success, k
    all of ``which`` but fold k.  Cuts lie halfway between neighbouring values of the rows that a model sees."""
    json = ", ".join(f"'{c}': {e}" for c, e in [("id", "id"), *[(c, f"f{i}") for i, c in enumerate(FOREST_FEATURES, 1)], ("kappa_actual", "y"), ("is_success", "quality")])
    coarse = [f"least({f'len(regexp_extract_all(text, {chr(39)}' + chr(92) + f'S+{chr(39)}))' if c == 'inst_tokens' else _hits(FIXTURE_LEXICON[c.split('_')[1]])} // {25 if c == 'inst_tokens' else 2}, 40)::BIGINT AS f{i}" for i, c in enumerate(FOREST_FEATURES, 1)]
    out = f"""WITH src AS MATERIALIZED (SELECT doc_id::BIGINT AS id, {', '.join(coarse)}, n_chars::BIGINT AS y, quality::BIGINT AS quality FROM documents JOIN labels USING (doc_id)),
rows AS MATERIALIZED (SELECT id, (row_number() OVER (ORDER BY md5(md5(to_json({{{json}}})::VARCHAR) || '-1-42')) - 1) % 3 AS fold FROM src WHERE {which}),
train AS MATERIALIZED (SELECT m, id, y FROM src JOIN rows USING (id), range(-1, 3) t(m) WHERE fold <> m UNION ALL SELECT -2, id, y FROM src WHERE quality = 1),
feature AS MATERIALIZED ({' UNION ALL '.join(f'SELECT id, {i} AS f, f{i} AS x FROM src' for i in range(1, 5))}),
cuts AS MATERIALIZED (SELECT * FROM (SELECT m, f, (x + lead(x) OVER (PARTITION BY m, f ORDER BY x)) / 2 AS cut FROM (SELECT DISTINCT m, f, x FROM train JOIN feature USING (id))) WHERE cut IS NOT NULL),
n0 AS MATERIALIZED (SELECT m, id, 1 AS node, false AS leaf FROM (SELECT DISTINCT m FROM train), src)"""
    for d in range(3):
        out += f""",
g{d} AS (SELECT m, node, f, cut, count(*) AS n, sum(y) AS s, sum(y * y) AS ss, count(*) FILTER (x <= cut) AS nl, sum(y) FILTER (x <= cut) AS sl, sum(y * y) FILTER (x <= cut) AS ssl FROM train JOIN n{d} USING (m, id) JOIN feature USING (id) JOIN cuts USING (m, f) WHERE NOT leaf GROUP BY ALL),
b{d} AS MATERIALIZED (SELECT m, node, unnest(arg_max({{'f': f, 'cut': cut, 'gain': gain}}, (round(gain, 3), -f, -cut))) FROM (SELECT *, (ss - s * s / n) - (ssl - sl * sl / nl) - ((ss - ssl) - (s - sl) * (s - sl) / (n - nl)) AS gain FROM g{d} WHERE nl > 0 AND nl < n) WHERE gain > 1e-6 GROUP BY m, node),
n{d + 1} AS MATERIALIZED (SELECT m, id, CASE WHEN cut IS NULL THEN node ELSE 2 * node + (x > cut)::INT END AS node, cut IS NULL AS leaf FROM n{d} LEFT JOIN b{d} USING (m, node) LEFT JOIN feature USING (id, f))"""
    means = "SELECT m, node, avg(y) AS p FROM train JOIN n3 USING (m, id) GROUP BY m, node"
    return out + f""",
splits AS ({' UNION ALL '.join(f'SELECT * FROM b{d}' for d in range(3))}), pred AS MATERIALIZED (SELECT m, id, p FROM n3 JOIN ({means}) USING (m, node))"""


CODE = "p_size % 3 + p_size % 2 + p_size % 5"
TALKS = "SELECT conv_id, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS input, avg((role = 'user')::INT) AS rate FROM conversations GROUP BY conv_id"


def _talk(column: str) -> str:
    return {"rate": "CASE WHEN conv_id % 7 <> 0 THEN rate ELSE 0.0 END", "tokens": "len(regexp_extract_all(input, '\\S+'))::BIGINT"}[column]


SQL: dict[str, str] = {
    "text_features_documents": _features_sql(),
    "lexicon_features_pages": "SELECT page_id, " + ", ".join(f"{_hits(Settings().lexicon[k], 'html')}::BIGINT AS inst_{k}_count" for k in ("class", "collection", "func")) + " FROM pages",
    "token_stats": "SELECT conv_id, turn, len(regexp_extract_all(text, '\\S+'))::BIGINT AS n_tokens, round(CASE WHEN len(regexp_extract_all(text, '\\S+')) > 0 THEN length(regexp_replace(text, '\\s', '', 'g')) / len(regexp_extract_all(text, '\\S+')) ELSE 0 END, 6) AS mean_len FROM conversations",
    "intent_scores": "SELECT doc_id, ("
    + " + ".join(f"contains(lower(text), '{p}')::BIGINT" for p in text.NESTING)
    + ")::BIGINT AS nesting_intent, ("
    + " + ".join(f"contains(lower(text), '{p}')::BIGINT" for p in text.ALGORITHMS)
    + ")::BIGINT AS algo_intent, round(CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / ln(len(w) + 1) ELSE 0 END, 6) AS instruction_complexity_score FROM (SELECT *, regexp_extract_all(lower(text), '\\S+') AS w FROM documents)",
    "pass_rate_list": "SELECT conv_id, round(avg((role = 'user')::INT), 6) AS pass_rate, (avg((role = 'user')::INT) >= 0.8)::INT AS is_success FROM conversations GROUP BY conv_id",
    "pass_rate_string": "SELECT p_partkey, round(CASE WHEN p_partkey % 3 = 0 THEN CASE WHEN p_size % 4 + p_size % 3 > 0 THEN (p_size % 4) / (p_size % 4 + p_size % 3) ELSE 0 END WHEN p_partkey % 3 = 1 THEN (p_size % 2 = 1 OR contains(lower(p_name), 'pass'))::INT ELSE 0 END, 6)::DOUBLE AS pass_rate FROM part",
    "json_flatten": "SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, 0) AS k FROM events",
    "defaults_fill": "SELECT doc_id::VARCHAR AS id, coalesce(quality, 1)::DOUBLE AS kappa_actual, coalesce(toxic, 0)::INT AS is_success, coalesce(lang, 'unknown') AS lang, 0.0::DOUBLE AS e_norm, 0::INT AS coupling_depth, 0.0::DOUBLE AS pass_rate FROM documents LEFT JOIN labels USING (doc_id)",
    "enrich_records": f"SELECT conv_id::VARCHAR AS id, round({_talk('rate')}, 6) AS pass_rate, ({_talk('rate')} >= 0.8)::BIGINT AS is_success, {_talk('tokens')} AS inst_tokens, {_hits(Settings().lexicon['class'], 'input')}::BIGINT AS inst_class_count, {_hits(Settings().lexicon['collection'], 'input')}::BIGINT AS inst_collection_count, CASE WHEN conv_id % 2 <> 0 THEN 1 + n END::BIGINT AS ast_cyclomatic, CASE WHEN conv_id % 3 <> 0 THEN n ELSE 1 END::DOUBLE AS kappa_cyclomatic, CASE WHEN conv_id % 5 <> 0 THEN n / 8 ELSE 0 END::DOUBLE AS e_norm, 0::BIGINT AS coupling_depth, 3::BIGINT AS extra FROM ({TALKS})",
    "load_records": f"SELECT conv_id::VARCHAR AS id, {_talk('tokens')} AS inst_tokens, {_hits(Settings().lexicon['collection'], 'input')}::BIGINT AS inst_collection_count, CASE WHEN conv_id % 3 <> 0 THEN n ELSE 1 END::DOUBLE AS kappa_actual, ({_talk('rate')} >= 0.8)::BIGINT AS is_success, CASE WHEN conv_id % 2 <> 0 THEN 'python' ELSE 'unknown' END AS lang, CASE WHEN conv_id % 5 <> 0 THEN n / 8 ELSE 0 END::DOUBLE AS e_norm, 0.0::DOUBLE AS m_mem_jaccard, 0::BIGINT AS coupling_depth, round({_talk('rate')}, 6) AS pass_rate, round({_talk('rate')}, 6) AS figure_rate, CASE WHEN conv_id % 5 <> 0 THEN n / 8 ELSE 0 END::DOUBLE AS figure_e FROM ({TALKS})",
    "ast_metrics": f"SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 AND {CODE} > 0 THEN 1 + 3 * (p_size % 5) END::BIGINT AS gated, (1 + 3 * (p_size % 5))::BIGINT AS ast_cyclomatic, ({CODE} > 0)::BIGINT AS ast_nesting_depth, (p_size % 3)::BIGINT AS ast_function_count, (p_size % 2)::BIGINT AS ast_class_count FROM part",
    "ast_recovered": f"SELECT p_partkey, (1 + 3 * (p_size % 5) + 2 * (p_size % 4))::BIGINT AS ast_cyclomatic, CASE WHEN p_size % 4 > 0 THEN 2 WHEN {CODE} > 0 THEN 1 ELSE 0 END::BIGINT AS ast_nesting_depth, (p_size % 3)::BIGINT AS ast_function_count, (p_size % 2)::BIGINT AS ast_class_count FROM part",
    "ols_multi_hc1": _ols_sql("SELECT 1.0::DOUBLE AS one, * FROM lineitem", ["one", "l_quantity", "l_discount", "l_tax"], "l_extendedprice", ["const", "l_quantity", "l_discount", "l_tax"]),
    "joint_nulls": "SELECT round(regr_slope(l_extendedprice, l_discount), 4) AS slope, count(*) AS n FROM lineitem WHERE l_linenumber NOT IN (3, 5)",
    "iv_2sls": f"WITH {_iv_sql()} " + _table_sql(["const", "l_discount", "l_tax", "kappa"], "1.0"),
    "first_stage": _first_stage_sql(),
    "hausman": _hausman_sql(),
    "stage2": _stage2_sql(),
    "threshold_controls": _wide_curve_sql("l_quantity", ["l_discount", "l_tax"], "l_extendedprice", "lineitem") + " SELECT gamma, round(f, 6) AS f_stat FROM f",
    "figure_threshold": _wide_curve_sql("l_quantity", ["l_discount"], "l_extendedprice", "lineitem") + " SELECT coalesce((SELECT gamma FROM f WHERE f IS NOT NULL ORDER BY round(f, 9) DESC, gamma LIMIT 1), 6.0)::DOUBLE AS gamma",
    "resampling_report": _resampling_sql(),
    "resampling_500": _resampling_500_sql(),
    "forest_oof": _tree_sql("quality = 1") + " SELECT s.id, round(w.p, 6) AS kappa_predicted, round(coalesce(h.p, w.p), 6) AS kappa_predicted_oof FROM src s JOIN pred w ON w.id = s.id AND w.m = -1 LEFT JOIN rows r ON r.id = s.id LEFT JOIN pred h ON h.id = s.id AND h.m = r.fold",
    "forest_importance": _tree_sql("quality = 1") + f" SELECT {FOREST_FEATURES}[f.i] AS feature, round(coalesce(sum(gain), 0) / (SELECT sum(gain) FROM splits WHERE m = -1), 6) AS importance FROM range(1, 5) f(i) LEFT JOIN splits s ON s.f = f.i AND m = -1 GROUP BY f.i",
    "forest_sensitivity": _tree_sql("true")
    + """, d AS (SELECT r.fold, s.y, p.p FROM rows r JOIN src s USING (id) JOIN pred p ON p.id = r.id AND p.m = r.fold), e AS (SELECT fold, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae FROM d GROUP BY fold)
SELECT round(avg(r2), 6) AS mean_r2, round(stddev_pop(r2), 6) AS sd_r2, round(min(r2), 6) AS min_r2, round(max(r2), 6) AS max_r2, round(avg(mae), 6) AS mean_mae, (SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) FROM d) AS oof_r2,
(SELECT round(corr(a.p, b.p), 6) FROM src JOIN pred a ON a.id = src.id AND a.m = -2 JOIN pred b ON b.id = src.id AND b.m = -1 WHERE quality <> 1) AS corr FROM e""",
    "success_split": "SELECT count(*) AS n, round(avg(toxic), 6) AS mean_toxic, CASE WHEN quality = 1 THEN 'success' ELSE 'failure' END AS side FROM labels GROUP BY side",
    "load_report": "SELECT count(*) AS n, round(avg(quality), 6) AS success_rate, round(avg(toxic), 6) AS mean_pass_rate, round(avg(n_chars), 6) AS mean_actual, round(avg(n_chars / 100.0::DOUBLE), 6) AS mean_predicted FROM documents JOIN labels USING (doc_id)",
    "fake_simple_report": "SELECT count(*) AS n, round(avg(t), 6) AS mean, round(median(t), 6) AS median, max(t)::BIGINT AS max FROM (SELECT len(regexp_extract_all(text, '\\S+')) AS t FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND quality = 0)",
    "regime_report": "SELECT count(*) FILTER (l_quantity <= 6.5) AS n_low, count(*) FILTER (l_quantity > 6.5) AS n_high, round(avg(l_discount) FILTER (l_quantity <= 6.5), 6) AS mean_low, round(avg(l_discount) FILTER (l_quantity > 6.5), 6) AS mean_high, round(avg(l_discount) FILTER (l_quantity <= 6.5) - avg(l_discount) FILTER (l_quantity > 6.5), 6) AS difference FROM lineitem",
    "naive_view": "SELECT l_quantity AS kappa, round(avg(l_discount), 6) AS mean_outcome, count(*) AS n FROM lineitem WHERE l_quantity <= 15 GROUP BY 1",
    "naive_view_clipped": "SELECT l_quantity AS kappa, round(avg(l_discount), 6) AS mean_outcome, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 12 GROUP BY 1",
    "corrected_view": "SELECT round_even(l_quantity / 2, 0)::DOUBLE AS kappa, round(avg(l_discount), 6) AS mean_outcome, count(*) AS n FROM lineitem GROUP BY 1 HAVING kappa <= 15",
    "corrected_view_clipped": "SELECT greatest(1, least(12, round_even(l_quantity / 2, 0)))::DOUBLE AS kappa, round(avg(l_discount), 6) AS mean_outcome, count(*) AS n FROM lineitem GROUP BY 1",
    "observed_labels": "SELECT 'κ_obs = ' || l_quantity::INT::VARCHAR AS label, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 1 AND 8 GROUP BY 1",
    "equal_width_bins": f"SELECT {_edges_sql('l_extendedprice', 'lineitem', 15, 'x')}::BIGINT AS bin, count(*) AS n, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem, {_range_sql('l_extendedprice', 'lineitem', 'x')} GROUP BY 1",
    "explicit_bins_flow": FLOW_SQL,
    "flow_labels": f"SELECT DISTINCT pred_bin FROM ({FLOW_SQL})",
    "phase_cells": f"SELECT k_bin, e_bin, round(m, 6) AS mean_outcome FROM ({_phase_sql(15, 15)})",
    "phase_pivot": f"SELECT k_bin, " + ", ".join(f"round(max(m) FILTER (e_bin = {i}), 6) AS e{i}" for i in (1, 2, 3)) + f" FROM ({_phase_sql(6, 3)}) GROUP BY k_bin",
    "phase_labelled": "SELECT k_bin, e_bin, round(m, 6) AS mean_outcome, ["
    + ", ".join(f"'{x}'" for x in binning.spread_labels(2, 16, 12, 0))
    + "][k_bin] AS k_label, ["
    + ", ".join(f"'{x}'" for x in binning.spread_labels(0.1, 0.9, 8, 2))
    + f"][e_bin] AS e_label FROM ({_phase_sql(12, 8)})",
    "binned_trend": f"WITH b AS (SELECT {_edges_sql('o_totalprice', 'orders', 40, 'x')}::BIGINT AS bin, o_totalprice AS x, o_custkey::DOUBLE AS y FROM orders, {_range_sql('o_totalprice', 'orders', 'x')}), a AS (SELECT bin, avg(x) AS mean_kappa, avg(y) AS mean_pass, count(*) AS \"count\", stddev_samp(y) / sqrt(count(*)) AS se FROM b GROUP BY bin HAVING count(*) >= 2) SELECT bin, round(mean_kappa, 6) AS mean_kappa, round(mean_pass, 6) AS mean_pass, \"count\", round(se, 6) AS se, round(mean_pass - 1.96 * se, 6) AS low, round(mean_pass + 1.96 * se, 6) AS high FROM a",
    "violin_stats": "SELECT l_linenumber AS kappa, count(*) AS n, round(min(l_extendedprice), 6) AS min, round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3, round(max(l_extendedprice), 6) AS max, round(avg(l_extendedprice), 6) AS mean FROM lineitem WHERE l_linenumber BETWEEN 1 AND 8 GROUP BY 1",
    "corr_failures": "SELECT round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem WHERE l_returnflag <> 'R'",
    "ols_simple": "SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, count(*) AS n FROM lineitem",
    "iv_single": "SELECT round(covar_samp(z, y) / covar_samp(z, k), 4) AS slope, count(*) AS n FROM (SELECT l_quantity AS z, l_quantity + 20 * e AS k, l_extendedprice / 1000 + 30 * e AS y FROM (SELECT *, ('0x' || substr(md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS e FROM lineitem))",
    "threshold_sql": _curve_sql("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem", "y", "x") + " SELECT gamma, round(f, 6) AS f_stat FROM c",
    "threshold_curve": _curve_sql("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem", "y", "x") + " SELECT gamma, round(f, 6) AS f_stat FROM c",
    "stream_curve": _curve_sql(ORDERS, "y", "x") + " SELECT gamma, round(f, 6) AS f_stat FROM c",
    "threshold_best": _curve_sql("SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem", "y", "x") + " SELECT gamma, round(f, 6) AS f_stat FROM c WHERE f IS NOT NULL ORDER BY round(f, 6) DESC, gamma LIMIT 1",
    "wild_bootstrap": _curve_sql(_boot_sql(5), "y", "x", "iter") + " " + SUP,
    "placebo": _curve_sql(_placebo_sql(5), "y", "x", "iter") + " " + SUP,
    "draw_report": "SELECT round(avg(l_extendedprice), 6) AS mean, round(stddev_pop(l_extendedprice), 6) AS sd, round(median(l_extendedprice), 6) AS median, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem",
    "exact_sample": "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id::VARCHAR || '-42'), doc_id LIMIT 100",
    "exact_sample_half": "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY md5(o_orderkey::VARCHAR || '-42')) AS r FROM orders) WHERE r <= (SELECT count(*) // 2 FROM orders)",
    "kfold_sizes": f"SELECT fold::BIGINT AS fold, count(*) AS n, sum(o_orderkey)::BIGINT AS key_sum FROM ({FOLDS}) GROUP BY fold",
    "cv_metrics": f"WITH d AS (SELECT fold, o_totalprice / 1000 AS y, o_custkey / 10.0::DOUBLE AS p FROM ({FOLDS})), f AS (SELECT fold, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, avg(abs(y - p)) AS mae FROM d GROUP BY fold) SELECT round(avg(r2), 6) AS mean_r2, round(stddev_pop(r2), 6) AS sd_r2, round(min(r2), 6) AS min_r2, round(max(r2), 6) AS max_r2, round(avg(mae), 6) AS mean_mae, (SELECT round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) FROM d) AS oof_r2 FROM f",
    "tfidf_max_cosine": TFIDF_SQL,
    "tfidf_joined": TFIDF_SQL,
}

NAMES = (
    "text_features_documents", "lexicon_features_pages", "token_stats", "intent_scores", "pass_rate_list", "pass_rate_string", "json_flatten", "defaults_fill", "success_split", "load_report", "fake_simple_report",
    "regime_report", "naive_view", "naive_view_clipped", "corrected_view", "corrected_view_clipped", "observed_labels", "equal_width_bins", "explicit_bins_flow", "flow_labels", "phase_cells", "phase_pivot", "phase_labelled",
    "binned_trend", "violin_stats", "corr_failures", "ols_simple", "ols_multi_hc1", "joint_nulls", "iv_single", "iv_2sls", "first_stage", "hausman", "stage2", "threshold_curve", "threshold_sql", "stream_curve", "threshold_best", "threshold_controls", "figure_threshold",
    "wild_bootstrap", "placebo", "resampling_report", "resampling_500", "draw_report", "exact_sample", "exact_sample_half", "kfold_sizes", "cv_metrics", "forest_oof", "forest_importance", "forest_sensitivity", "forest_full", "tfidf_max_cosine", "tfidf_joined", "ast_metrics", "ast_recovered", "enrich_records", "load_records",
)


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
