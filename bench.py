"""Times the headline queries; prints one JSON line.

Every query runs once to warm up and is then timed as the best of two runs
writing to nothing, so all its rows and columns are computed.  The ingest
query reads price files derived from the tables; writing those is not timed.
"""

from __future__ import annotations

import json
import os
import time

import fixtures as X
import registry as Q
from pricelake.operators import dedup as D, normalize as N
from pricelake.plans import ingest as I
from pricelake.runtime import build_session, new_folder, written
from pricelake.sources import sniff as S

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def ingest(kind):
    def run(spark):
        files = S.manifest(spark, X.price_files(spark, SF_DIR, kind))
        consume(I.ingest_files(files, I.Options(ingested_at=Q.THEN)).operations)

    return run


def stored(kind):
    """Ingest as above, and both tables written."""

    def run(spark):
        files = S.manifest(spark, X.price_files(spark, SF_DIR, kind))
        result = I.ingest_files(files, I.Options(ingested_at=Q.THEN))
        Q.W.store(result, new_folder(spark, "bench-tables"))

    return run


def over_stored(query):
    """A serving query over stored tables, as users run it."""
    return lambda spark: consume(query(spark, _stored(spark), X.hospitals(spark, SF_DIR)))


_tables = {}


def _stored(spark):
    if "operations" not in _tables:
        _tables["operations"] = written(
            Q.W.to_table_types(Q.table_operations(spark, SF_DIR)), "bench"
        )
    return _tables["operations"]


def queries():
    raw = lambda spark: X.raw_charges(spark, SF_DIR)
    return {
        "normalize": lambda s: consume(N.normalize(raw(s))),
        "best_records": lambda s: consume(D.best_records(N.accept(raw(s)))),
        "top_operations": over_stored(
            lambda s, ops, hospitals: Q.V.display(
                Q.V.most_expensive(ops, hospitals, description="ring", min_price=500.0)
            )
        ),
        "pricing_summary": over_stored(lambda s, ops, h: Q.V.pricing_summary(h, ops)),
        "code_lookup": over_stored(lambda s, ops, h: Q.V.with_code(ops, "0476")),
        "similar_queries": lambda s: consume(Q.similar_queries(s, SF_DIR)),
        "matched_columns": lambda s: consume(Q.matched_columns(s, SF_DIR)),
        "raw_to_top_operations": lambda s: consume(Q.top_operations(s, SF_DIR)),
        "ingest_csv": ingest("csv"),
        "ingest_json": ingest("json"),
        "store_csv": stored("csv"),
    }


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, run in queries().items():
        run(spark)
        times = []
        for _ in range(2):
            start = time.perf_counter()
            run(spark)
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
