"""Times the headline queries on the given tables and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from feedscope.queries import all_queries  # noqa: E402
from feedscope.session import build_session  # noqa: E402

HEADLINE = ["item_scores", "top_items", "global_rank", "list_page", "relevance", "topic_edges", "top_words", "dedup_titles",
            "dedup_urls", "history_merge", "published_fill", "title_fill_contained", "title_fill", "title_suffix", "title_keys",
            "url_normalize", "page_links", "page_titles", "page_body", "paragraph_reflow", "note_text", "note_round_trip",
            "wiki_links", "digest_pick", "digest_text", "daily_counts", "health_streaks", "half_hour_buckets", "feed_entries",
            "api_records", "search_results", "catalogue_entries", "catalogue_topics", "stream_history", "stream_repeats"]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else None,
                          **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads before the first timing
    queries, times = all_queries(), {}
    for name in [n for n in (sys.argv[1:] or HEADLINE) if n in queries]:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(folder).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
