"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` (default sf0.1) and ``BENCH_CPUS`` (default 8) set the scale.
The lines of the documents are also matched ten times over, where job start and
planning weigh little; ``mb_per_second`` says how many bytes that is.
Every query is planned and run afresh per round and written to a sink that
takes all rows; the best of ``BENCH_ROUNDS`` (default 3) counts.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "category_rollup",
    "document_strings",
    "match_longest_documents",
    "match_contains_documents",
    "match_regex_documents",
    "match_benchmark_passages",
    "match_benchmark_distributed",
    "findings_by_document",
    "findings_by_source",
    "budgeted_findings",
    "findings_all_kinds",
    "order_haystack",
    "byte_budget_orders",
    "byte_budget_sources",
    "first_orders",
    "blocking_counts",
    "rule_prevalence",
    "findings_diff",
    "verdict_counts",
    "verdict_documents",
    "history_upsert",
]


def main() -> None:
    from functools import reduce

    from pyspark.sql import DataFrame, functions as F

    from rulesieve.operators import findings, matching
    from rulesieve.plans import corpus
    from rulesieve.plans.queries import QUERIES
    from rulesieve.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    rounds = int(os.environ.get("BENCH_ROUNDS", "3"))
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "12g", "bench")
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    lines = QUERIES["document_strings"](spark, sf_dir).count()
    names = sys.argv[1:] or HEADLINE
    for name in names:  # warm the JVM and the Python workers
        run(name)
    best = {name: round(min(run(name) for _ in range(rounds)), 3) for name in names}
    # The same files ten times over: what counts here is the text, not the job.
    tenfold = reduce(DataFrame.union, [corpus.document_evidence(spark, sf_dir)] * 10)
    catalogue = corpus.catalogue(spark)
    large = {
        "match_longest_tenfold": lambda: matching.match_longest(tenfold, catalogue),
        "match_contains_tenfold": lambda: matching.match_contains(tenfold, catalogue),
        "findings_tenfold": lambda: findings.scan(tenfold, catalogue),
    }
    megabytes = tenfold.agg(F.sum(F.octet_length("value") + 1)).first()[0] / 1e6
    seconds = {}
    for name, make in large.items() if len(sys.argv) == 1 else ():
        for _ in range(2):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            seconds[name] = round(min(took, seconds.get(name, took)), 3)
    per_second = {
        name: round(lines / best[name])
        for name in ("match_longest_documents", "match_contains_documents", "category_rollup")
        if name in best
    }
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(best.values()), 3),
                "unit": "sec",
                "queries": best,
                "lines": lines,
                "lines_per_second": per_second,
                "tenfold_seconds": seconds,
                "tenfold_mb": round(megabytes, 1),
                "mb_per_second": {name: round(megabytes / s, 1) for name, s in seconds.items()},
                "sf": sf_dir.rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
