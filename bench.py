"""Time the headline queries: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``.

Prints one JSON line.  A query's time covers building its plan and writing its whole result to
the no-op sink; queries that materialise shared steps do so within their time.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINES = [
    "r4_route_targets",
    "s4_recent_messages",
    "j4_comments_with_fallback",
    "j5_attach_comments",
    "t11_clean_text",
    "t13_split_sentences",
    "t15_prepare_sentences",
    "f2_term_freq",
    "f3_doc_freq",
    "f5_idf",
    "f6_tfidf",
    "f6_tfidf_long",
    "m6_stratified_split",
    "m9_predict",
    "m9_predict_long",
    "m11_classification_report",
    "m13_train",
    "o1_score_documents",
    "o3_label_summary",
    "o4_label_samples",
    "o8_analyze_summary",
]


def main() -> None:
    from fidelscope.session import build_session
    from workload.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str, folder: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    names = sys.argv[1:] or HEADLINES
    run("o1_score_documents", sf_dir)  # start-up and compilation are not part of the figures
    seconds = {name: round(run(name, sf_dir), 3) for name in names}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    sentences = QUERIES["t15_prepare_sentences"](spark, sf_dir).count()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
        "documents": rows,
        "sentences": sentences,
        "sentences_per_sec": {
            name: round(sentences / seconds[name])
            for name in ("t15_prepare_sentences", "o1_score_documents")
            if name in seconds
        },
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
