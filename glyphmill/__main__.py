"""Command line: list the queries, or write one's result as parquet.

python -m glyphmill list
python -m glyphmill run QUERY TABLES OUT
"""

from __future__ import annotations

import json
import sys

from glyphmill import plans
from glyphmill.session import local_session

#: Ends of a run: done, broken, wrong call, unknown query.
DONE, BROKEN, USAGE, UNKNOWN = 0, 1, 2, 3


def main(argv: list[str]) -> int:
    known = plans.queries()
    if argv == ["list"]:
        print("\n".join(sorted(known)))
        return DONE
    if len(argv) != 4 or argv[0] != "run":
        print(__doc__, file=sys.stderr)
        return USAGE
    _, name, tables, out = argv
    if name not in known:
        print(f"no such query: {name}", file=sys.stderr)
        return UNKNOWN
    spark = local_session()
    try:
        known[name](spark, tables).write.mode("errorifexists").parquet(out)
        print(json.dumps({"query": name, "rows": spark.read.parquet(out).count(), "out": out}))
        return DONE
    except Exception as error:
        print(f"{type(error).__name__}: {str(error).splitlines()[0]}", file=sys.stderr)
        return BROKEN
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
