"""Times headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores. Kernels are
timed on the cached raw lines of the derived corpus, median of BENCH_REPEATS
(default 2) runs after a warm-up, and also given in MB of UTF-8 text a second; whole queries once,
from building them (with a lexicon made anew) to their last row. ``pretokenize`` runs on the documents as
they are and ``normalize`` on text with marks, each with its own number of MB.
"""

from __future__ import annotations

import json
import os
import statistics
import time


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from wordlattice.functions import columns as fn
    from wordlattice.operators import render
    from wordlattice.operators.segment import Options, segment
    from wordlattice.plans import fixtures as fx
    from wordlattice.plans import queries as core

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(build) -> float:
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    def whole(name):
        fx.lexicon.cache_clear()
        spark.catalog.clearCache()
        return core.QUERIES[name](spark, sf_dir)

    def cached(df):
        df = df.repartition(cpus * 4).cache()
        return df, df.agg(F.sum(F.octet_length("text"))).first()[0] / 1e6

    raw, size = cached(fx.raw(spark, sf_dir))
    (mixed, mixed_size), (marked, marked_size) = cached(fx.documents(spark, sf_dir)), cached(fx.raw(spark, sf_dir, fx.MARKS))
    lexicon = fx.lexicon(spark, sf_dir)
    lexicon.entries.count()
    kernels = {"pretokenize": mixed.select(fn.pretokenize(F.col("text"))), "normalize": marked.select(fn.normalize(F.col("text")))}
    sizes = {"pretokenize": mixed_size, "normalize": marked_size}
    for algorithm in ("viterbi", "fmm", "bmm", "bimm"):
        kernels[f"segment_{algorithm}"] = segment(raw, lexicon, Options(algorithm)).select("tokens")
    tokens = segment(raw, lexicon)
    kernels |= {"end_to_end_space": tokens.select(render.to_space(F.col("tokens"))), "end_to_end_json": tokens.select(render.to_jsonl(F.lit(1), F.col("tokens")))}
    seconds, rates = {}, {}
    for name, df in kernels.items():
        timed(lambda df=df: df)
        seconds[name] = round(statistics.median(timed(lambda df=df: df) for _ in range(int(os.environ.get("BENCH_REPEATS", "2")))), 3)
        rates[name] = round(sizes.get(name, size) / seconds[name], 2)
    for name in ("clusters_km_marks", "normalize_km_marks", "pretokenize_documents", "lexicon_costs", "render_json", "eval_summary", "oov_split", "em_round"):
        seconds[name] = round(timed(lambda name=name: whole(name)), 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir, "cpus": cpus, "mb_text": round(size, 2), "mb_per_sec": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
