import os

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"


def test_entry_and_names(spark):
    assert entry_module.entry(spark).count() == 26
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", ["text_features_documents", "explicit_bins_flow", "threshold_curve", "placebo", "cv_metrics", "ols_multi_hc1", "iv_2sls", "first_stage", "hausman", "threshold_controls", "enrich_records", "load_records", "pass_rate_string", "ast_metrics", "forest_oof", "forest_importance", "forest_sensitivity", "tfidf_max_cosine", "tfidf_joined", "stage2", "violin_stats"])
def test_sql_agrees(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    mine = entry_module.queries()[name](spark, SF)
    names = sorted(mine.columns)
    theirs = c.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({entry_module.oracle_sql()[name]})").fetchall()
    key = lambda rows: sorted([tuple(float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for v in r) for r in rows], key=repr)
    assert key([tuple(r) for r in mine.select(*names).collect()]) == key(theirs)
