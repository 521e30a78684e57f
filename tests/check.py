"""Run registered queries against their SQL: ``python tests/check.py [sf] [key ...]``."""

from __future__ import annotations

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, diff  # noqa: E402


def session():
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    return spark


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    keys = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = session(), connect(sf_dir)
    qs, os_ = entry.queries(), entry.oracle_sql()
    picked = [k for k in qs if not keys or any(k == w or (w.endswith("*") and k.startswith(w[:-1])) for w in keys)]
    failed = 0
    for k in picked:
        t = time.time()
        try:
            df = qs[k](spark, sf_dir)
            if k in os_:
                msg = diff(df, con, os_[k])
                note = "OK" if msg is None else "DIFF " + msg
            else:
                n = df.count()
                msg = None if n else "empty"
                note = f"rows {n}" if n else "DIFF empty"
        except Exception as e:  # report and go on
            msg = note = "ERROR " + f"{type(e).__name__}: {e}".split("JVM stacktrace")[0][:600]
        failed += msg is not None
        print(f"{time.time() - t:6.2f}s {k}: {note}", flush=True)
    print(f"{len(picked)} checked, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
