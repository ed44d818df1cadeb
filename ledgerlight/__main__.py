"""python -m ledgerlight list | run QUERY --data DIR [--out PATH] [--partitions N]: the queries from a command line."""

from __future__ import annotations

import argparse

from .sources import extracts


def main(arguments: list[str] | None = None, spark=None) -> int:
    from . import queries

    parser = argparse.ArgumentParser("ledgerlight")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("query")
    run.add_argument("--data", required=True)
    run.add_argument("--out")
    run.add_argument("--partitions", type=int)
    a = parser.parse_args(arguments)
    if a.command == "list":
        print("\n".join(sorted(queries.QUERIES)))
        return 0
    if a.query not in queries.QUERIES:
        parser.error(f"no such query: {a.query}")
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("ledgerlight").getOrCreate()
    if a.partitions:
        spark.conf.set("spark.sql.shuffle.partitions", a.partitions)
    log = extracts.RunLog()
    log(f"{a.query} on {a.data}")
    df = queries.QUERIES[a.query](spark, a.data)
    if a.out:
        extracts.write(df, a.out)
        log(f"written to {a.out}")
    else:
        print(extracts.markdown(df))
    print(log.text())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
