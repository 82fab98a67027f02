"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from lacuna.plans import queries as Q
from lacuna.plans.estimators import BiScale, SoftImputeALS
from lacuna.session import Scratch, session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    cells = Scratch(spark, "bench").write(Q.cells_of(spark, FOLDER), "cells")
    seconds: dict[str, float] = {}

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    def timed(name, run):
        """The time of one run, or of the median of three if the first was short."""
        times = []
        while not times or (len(times) < 3 and times[0] < 5):
            begin = time.perf_counter()
            out = run()
            times.append(time.perf_counter() - begin)
        seconds[name] = round(sorted(times)[len(times) // 2], 3)
        return out

    timed("ratings_assembly", lambda: drain(Q.cells_of(spark, FOLDER)))
    for name in ("support_clip", "lno_train", "kfold_assign", "center_pass1", "center_residual", "sddmm",
                 "splr_r_mult", "factor_svd", "predict_pairs", "heldout_mse"):
        timed(name, lambda: drain(Q.REGISTRY[name](spark, FOLDER)))
    centers = timed("bicenter_fit", lambda: BiScale().fit(cells))
    seconds["bicenter_per_pass"] = round(seconds["bicenter_fit"] / len(centers.trace_levels), 3)
    fixed = dict(shrinkage_value=9.0, convergence_threshold=0.0)
    model = timed("als_fit_rank10_5it", lambda: SoftImputeALS(max_rank=10, max_iters=5, **fixed).fit(cells))
    timed("als_fit_rank2_5it", lambda: SoftImputeALS(max_rank=2, max_iters=5, **fixed).fit(cells))
    timed("train_rmse", model.train_rmse)
    pairs = spark.range(1_000_000).selectExpr(
        f"id * 7919 % {model.scalars['n_rows']} AS row_id", f"id * 104729 % {model.scalars['n_cols']} AS col_id")
    timed("score_1m_pairs", lambda: drain(model.transform(pairs)))
    model.index_cells()
    few = spark.createDataFrame(pairs.limit(1000).toPandas())
    timed("predict_few_1000_pairs", lambda: drain(model.predict_few(few)))
    batch = SoftImputeALS(max_iters=3, **fixed)
    timed("fit_4_settings_3it", lambda: batch.fit_many(cells, [
        {batch.max_rank: rank, batch.shrinkage_value: x} for rank in (10, 20) for x in (0.02, 10.0)]))
    timed("soft_impute_fit", lambda: drain(Q.REGISTRY["soft_impute_fit"](spark, FOLDER)))
    timed("mllib_als_baseline", lambda: drain(Q.REGISTRY["mllib_als_baseline"](spark, FOLDER)))
    total = sum(v for k, v in seconds.items() if k != "bicenter_per_pass")
    by_comparator = {k: round(v / seconds["mllib_als_baseline"], 3) for k, v in seconds.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(total, 3), "unit": "sec", "queries": seconds,
                      "divided_by_mllib_als_baseline": by_comparator,
                      "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
