"""Compare named queries with their SQL: ``python tests/check.py [sf_dir] [name-part …]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import connect, difference  # noqa: E402

from plumbline.catalog import ORACLES, QUERIES  # noqa: E402
from plumbline.session import build_session  # noqa: E402


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                              "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for name, fn in QUERIES.items():
        if argv[1:] and not any(part in name for part in argv[1:]):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                why = difference(fn(spark, sf_dir), con, ORACLES[name])
            else:
                why = None if fn(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
        failed += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {time.time() - start:6.1f}s {name} {why or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
