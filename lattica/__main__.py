"""LC1: a thin command line: list the queries, or run one over a folder of tables and write or show its rows."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> int:
    from lattica.plans import audits, registry  # noqa: F401

    parser = argparse.ArgumentParser(prog="lattica", description=__doc__)
    parser.add_argument("query", nargs="?", help="a query's name; without one, all names are listed")
    parser.add_argument("folder", nargs="?", help="folder of parquet tables")
    parser.add_argument("--out", help="write the rows there as parquet")
    given = parser.parse_args(args)
    if not given.query:
        print(*sorted(registry.QUERIES), sep="\n")
        return 0
    if given.query not in registry.QUERIES or not given.folder:
        parser.error("a known query and a folder are needed")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    df = registry.QUERIES[given.query](SparkSession.builder.getOrCreate(), given.folder)
    if given.out:
        df.write.mode("error").parquet(given.out)
        logging.info("written to %s", given.out)
    else:
        df.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
