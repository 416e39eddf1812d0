"""Times the headline queries; prints one line of JSON. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keyloom import session  # noqa: E402
from keyloom.plans import QUERIES, keys  # noqa: E402

HEADLINE = [
    "enrich_layout", "enrich_linguistic", "flagship_layout_rates", "layout_pivot", "ngram_counts_2", "ngram_zipf", "word_topk", "suffix_vocab", "corpus_clean",
    "zscore", "outlier_segments", "typo_split", "context_window", "fold_masks", "fold_balance", "link_identical", "topk_per_group", "bootstrap_cluster", "bias_shift",
    "rewrite_eval", "word_frequency", "key_features_trigram", "movement",
]

#: Headline queries that are timed by all their rows, every column written, instead of by the sums of these rows.
ROWS = {"enrich_layout": keys.layout_rows, "enrich_linguistic": keys.linguistic_rows}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    spark = session.local(cpus, **{"spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text))").collect()
    n_keys = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(length(text)) AS n").first().n
    times = {}
    for name in HEADLINE:
        start = time.time()
        ROWS.get(name, QUERIES[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    rates = {f"{k}_keys_per_s": round(n_keys / times[k]) for k in ("enrich_layout", "enrich_linguistic")}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), **rates}))


if __name__ == "__main__":
    main()
