"""python tests/check.py <folder> <name prefixes...>: compare and time queries."""

import sys
import time
import traceback
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from compare import connect, differences  # noqa: E402

from catalog import registry  # noqa: E402


def main(folder, *prefixes):
    from conftest import build_session

    areas = [a for a in registry.AREAS if f"@{a}" in prefixes]
    if areas:
        registry.AREAS = tuple(areas)
    registry.load_all()
    wanted = [p for p in prefixes if not p.startswith("@")]
    spark = build_session()
    con = connect(folder)
    bad = []
    for name, run in registry.QUERIES.items():
        if wanted and not any(name.startswith(p) for p in wanted):
            continue
        start = time.time()
        try:
            df = run(spark, folder)
            sql = registry.CHECK_SQL.get(name)
            if sql is None:
                n = len(df.collect())
                diff = [] if n else ["no rows"]
                note = f"rows only ({n})"
            else:
                diff = differences(df, con, sql)
                note = "ok"
        except Exception as exc:
            diff, note = [type(exc).__name__ + ": " + str(exc)[:1500]], ""
            if "-v" in prefixes:
                traceback.print_exc()
        took = time.time() - start
        print(f"{'FAIL' if diff else note:>16} {took:6.2f}s {name}", flush=True)
        for d in diff:
            print("      ", d)
        if diff:
            bad.append(name)
    print("failed:", bad)


if __name__ == "__main__":
    main(*sys.argv[1:])
