"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from factloom.session import build_session

HEADLINE = [
    "density_bins", "chunk_summary", "tier1_passage_match", "negatives_anti", "fuzzy_align", "name_clusters", "partition_metrics", "vector_separation",
    "binary_metrics", "fleiss_kappa", "quarter_sets", "cumulative_share", "forward_fill", "stratified_split", "scope_tally", "dup_hash",
    "search_terms", "term_counts", "paragraph_features", "chunk_checks", "repaired_clusters", "evidence_reasons", "act_evidence", "order_agreement",
    "gate_metrics", "cluster_frequency", "boundary_rows", "signed_proxy", "density_grid", "name_grid", "windowed_counts", "clusters_vs_gold",
    "act_changes", "log_second_stage", "extraction_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session(f"local[{os.environ.get('BENCH_CPUS', '8')}]", "factloom-bench", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    from factloom import plans

    took = {}
    for name in HEADLINE:
        begin = time.time()
        plans.queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - begin, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rsplit("/", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
