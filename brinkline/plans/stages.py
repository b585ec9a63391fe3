"""The two analysis stages and the figure data, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings, present
from ..operators import forest, moments, regression, summary, threshold
from ..sources import tasks


def stage1(spark: SparkSession, source: str, model_path: str | None = None, settings: Settings | None = None) -> forest.Stage1:
    settings = settings or Settings()
    df = tasks.load_stage1(spark, source)
    features = present(settings.instruments, df.columns)
    if not features:
        raise ValueError("no feature column is present")
    out = forest.train(df, features, settings=settings)
    if model_path:
        forest.save(out.model, model_path)
    return out


def stage2(df: DataFrame, settings: Settings | None = None, kappa: str = "kappa_predicted", summary_path: str | None = None) -> dict:
    """The whole battery on a scored frame; ``kappa`` may name the out-of-fold column.

    One scan for the moments of all estimators, one for their residuals and
    one for each kind of resampling, which tells rows apart by a key of their
    own, as ids may be missing or repeat.
    """
    settings = settings or Settings()
    controls, instruments = present(settings.controls, df.columns), present(settings.instruments, df.columns)
    df = forest.with_row_key(df).persist()
    y, actual = "pass_rate", "kappa_actual"
    found = moments.cube(df, [kappa, actual, *controls, *instruments, y], threshold.cell_of(F.col(kappa).cast("double"), settings.grid), len(settings.grid) + 1)
    every = found.of([*controls, actual, *instruments, y])
    h, h_p = regression.hausman_of(every, y, actual, controls, instruments)
    naive, iv = regression.settled(df, [regression.least_squares(found.of([actual, *controls, y]), y, [actual, *controls], True), regression.instrumented(every, y, actual, controls, instruments)])
    found = threshold.searched(found, df, y, kappa, controls, settings)
    boot = threshold.wild_bootstrap(found, F.col(forest.ROW), settings.bootstrap)
    p = threshold.share_at_least(boot, found.sup)
    fake = threshold.placebo(found, F.col(forest.ROW), settings.placebo) if found.gamma is not None else []
    facts = {
        "coefficient": iv.of("kappa_actual")[0] if iv else None, "coefficient_p": iv.table()[iv.names.index("kappa_actual")][3] if iv else None, "first_stage_f": iv.info["f"] if iv else None,
        "hausman": h, "hausman_p": h_p, "gamma": found.gamma, "bootstrap_p": p,
    }
    df.unpersist()
    if summary_path:
        tasks.write_summary(df.sparkSession, facts, summary_path)
    return {"naive": naive, "iv": iv, "search": found, "bootstrap": boot, "placebo": fake, "comparison": threshold.compare(found, fake), "verdict": threshold.verdict(p), "facts": facts}


def figures(df: DataFrame, settings: Settings | None = None) -> dict[str, DataFrame]:
    """Data of the figures, one frame for each."""
    settings = settings or Settings()
    controls = present(("e_norm",), df.columns)
    found = threshold.search(df, "pass_rate", "kappa_predicted", controls, settings)
    gamma = threshold.figure_threshold(df, "pass_rate", "kappa_predicted", controls, settings)
    return {
        "naive": summary.naive_view(df, "kappa_actual", "pass_rate"),
        "corrected": summary.corrected_view(df, "kappa_predicted", "pass_rate"),
        "phase": summary.phase_pivot(df, "kappa_predicted", "e_norm", "pass_rate"),
        "curve": found.frame(df.sparkSession),
        "regimes": summary.regime_report(df, "kappa_predicted", "pass_rate", gamma),
        "violins": summary.violin(df, "kappa_actual", "kappa_predicted"),
        "flow": summary.flow(df, "kappa_predicted", "kappa_actual"),
        "trend": summary.binned_trend(df, "kappa_predicted", "pass_rate"),
        "phase_labels": summary.phase_cells(df, "kappa_predicted", "e_norm", "pass_rate", 12, 8, labels=True),
        "before": summary.naive_view(df, "kappa_actual", "pass_rate", 1, 12),
        "after": summary.corrected_view(df, "kappa_predicted", "pass_rate", (1, 12)),
    }
