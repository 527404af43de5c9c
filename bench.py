"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}. Each
query runs its full plan into the ``noop`` sink (nothing is collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans.registry import QUERIES  # noqa: E402
from quire.session import build_session  # noqa: E402

HEADLINE = [
    "answer_topics",        # flagship: history gate + search + annotate + report
    "search_literature",    # match + BM25 + top-k per topic
    "topic_report",         # R7 end to end
    "bm25_topk",            # free-text BM25 over the whole corpus
    "hybrid_search",        # dense + BM25 + reciprocal-rank fusion
    "cosine_topk",          # exact vector top-k
    "embed_documents",      # hashed embedding of every article
    "conversation_tail",    # token-budget window
    "map_medline",          # MEDLINE write + read + parse
    "stream_ingest",        # two availableNow runs, first write wins
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", app="quire-bench",
                          shuffle_partitions=int(cpus))
    # Untimed JVM warm-up (class loading, JIT) on the smallest scale.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        QUERIES["search_literature"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.time()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
