"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from quillspark.plans.catalog import QUERIES  # noqa: E402
from quillspark.session import local_session, ship  # noqa: E402

HEADLINE = [
    "chunk_stats", "chunk_rows", "chunk_rows_b100", "sentence_rows", "longest_clauses",
    "normalize_typography", "repair_damage", "slugs", "html_blocks", "html_chapters",
    "chapter_numbers", "container_spine", "token_counts", "majority_spelling", "unknown_words",
    "oov_candidates", "oov_top30", "lexicon_apply", "lexicon_apply_joined",
    "lexicon_apply_phrases", "affected_chapters", "example_sentences", "review_variants",
    "lexicon_upsert", "synthesis_requests", "chapter_durations", "chapter_wavs",
    "chapter_marks", "metadata_blocks", "pending_chunks", "inbox_pending", "live_audio",
    "book_meta", "chapters_json", "inbox_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = ship(local_session(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.perf_counter()
        # The no-op sink computes every column of every row and keeps none.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
