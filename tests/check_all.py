"""Command line: compare registered queries with their SQL at one scale factor.

python tests/check_all.py 0.01 [name prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from recon.plans.defects import DEFECTS_BY_ID  # noqa: E402
from recon.plans.reports import PIPELINES  # noqa: E402
from recon.session import build_session  # noqa: E402
from tests.compare import compare, open_duckdb  # noqa: E402


def main() -> int:
    folder = f"/root/testdata/sf{sys.argv[1]}"
    wanted = tuple(a for a in sys.argv[2:] if not a.startswith("--"))
    with_sql = "--no-sql" not in sys.argv
    only_operators = "--operators" in sys.argv
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = open_duckdb(folder), oracle_sql(), 0
    for name, run in queries().items():
        if wanted and not name.startswith(wanted):
            continue
        if only_operators and (name in PIPELINES or name.split("_")[-1] in DEFECTS_BY_ID):
            continue
        started = time.time()
        try:
            got = run(spark, folder).toPandas()
            spark_s = time.time() - started
            verdict = "no SQL"
            if with_sql and name in sql:
                verdict = compare(got, con.execute(sql[name]).df())
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            got, spark_s, verdict = [], time.time() - started, f"{type(error).__name__}: {str(error)[:400]}"
        bad += verdict not in ("", "no SQL")
        total = time.time() - started
        print(f"{name:26s} rows={len(got):7d} spark={spark_s:6.2f} sql={total - spark_s:6.2f} {verdict or 'ok'}",
              flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
