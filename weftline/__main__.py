"""python -m weftline QUERY DIRECTORY [OUTPUT]: runs a registered query over a folder of tables; shows it, or writes Parquet."""

from __future__ import annotations

import argparse
import importlib
import importlib.util

from weftline.plans import evaluation, reference  # noqa: F401
from weftline.session import get_session


def registry() -> dict:
    out = dict(reference.queries())
    if importlib.util.find_spec("weftline.llm") and importlib.util.find_spec("weftline.llm.queries"):
        out |= importlib.import_module("weftline.llm.queries").queries()
    return out


def main(argv: list[str] | None = None) -> int:
    queries = registry()
    p = argparse.ArgumentParser(prog="weftline", description=__doc__)
    p.add_argument("query", choices=sorted(queries), metavar="QUERY")
    p.add_argument("directory")
    p.add_argument("output", nargs="?")
    p.add_argument("--master", default="local[*]")
    p.add_argument("--rows", type=int, default=20, help="rows shown where there is no output")
    a = p.parse_args(argv)
    df = queries[a.query](get_session(a.master), a.directory)
    if a.output:
        df.write.mode("overwrite").parquet(a.output)
    else:
        df.show(a.rows, truncate=80)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
