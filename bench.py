"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import statistics
import sys
import time

from newsweave.catalog import all_queries
from newsweave.catalog.fixtures import token_vectors
from newsweave.catalog.vector_queries import quantised_index
from newsweave.session import build_session

HEADLINE = [
    "nearest_articles_per_user",
    "agg2_profiles_all_rows",
    "sim2_exact_by_cells",
    "sim2_exact_by_blocks",
    "sim3_approximate_top_k",
    "sim3_quantised_top_k",
    "win1_negative_sampling",
    "ml1_training_samples",
    "win5_factor_recommendations",
    "ml9_clusters",
    "txt4_document_vectors",
    "txt7_new_document_vectors",
    "agg3_ground_truth",
    "ev3_mean_ranking_metrics",
    "agg5_last_wins",
    "agg12_capped_sources",
    "win2_batch_numbers",
    "fn22_many_requests",
    "snk4_upsert",
    "ml11_content_job",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    chosen = sys.argv[1:] or HEADLINE
    # Start the JVM and the Python workers, and store the word vectors and the index
    # that some queries take as given, before the clock runs.
    queries["nearest_articles_per_user"](spark, folder).write.format("noop").mode("overwrite").save()
    token_vectors(spark, folder)
    quantised_index(spark, folder)
    times = {}
    for name in chosen:
        runs = []
        for _ in range(repeats):
            start = time.perf_counter()
            with contextlib.redirect_stdout(sys.stderr):
                queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
