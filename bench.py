"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the number of local threads.
Each query is built and fully computed (``noop`` sink). Two other queries run
first, so that the start of the JVM and of the Python workers is not counted.
"""

import json
import os
import tempfile
import time

from changewatch import session
from changewatch.plans import catalog, catalog_changes, catalog_extract  # noqa: F401

HEADLINE = (
    "listing_table_rows",
    "listing_cards",
    "feed_items",
    "page_links",
    "page_details",
    "page_block_text",
    "url_forms",
    "text_hashes",
    "paged_listing",
    "merged_titles",
    "last_wins_documents",
    "fold_steps",
    "fold_snapshot",
    "page_changes",
    "new_events",
    "new_event_rows",
    "merged_documents",
    "listed_documents",
    "classified_documents",
    "dated_events",
    "constraint_checks",
    "messages",
    "payloads",
    "two_runs",
)

WARM_UP = ("status_labels", "page_links_by_selector")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = session.build(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(2 * int(cpus)) if cpus.isdigit() else "16",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="changewatch-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
