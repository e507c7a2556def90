"""python -m lynceus version | create-scoped ENTITIES ROOT [--query JSON] [--format FORMAT] [--keep N]"""

from __future__ import annotations

import argparse
import os

from lynceus import __version__


def main(argv: list[str] | None = None) -> str:
    """Run a command and return what it prints."""
    parser = argparse.ArgumentParser(prog="lynceus")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("version", help="print the version")
    scoped = commands.add_parser("create-scoped", help="write a new version of the scoped subset of an entity table")
    scoped.add_argument("entities", help="path of the entity table")
    scoped.add_argument("root", help="folder of the subset's versions")
    scoped.add_argument("--query", default=os.environ.get("SCOPED_INDEX_QUERY"), help="field to accepted values, as JSON; without it sanctioned people, organisations and vehicles")
    scoped.add_argument("--format", default="parquet", help="format of the entity table, or jsonl")
    scoped.add_argument("--keep", type=int, default=2, help="versions that stay")
    args = parser.parse_args(argv)
    if args.command == "version":
        return __version__
    from pyspark.sql import SparkSession

    from lynceus.session import ready
    from lynceus.sources import store

    spark = ready(SparkSession.builder.getOrCreate())
    entities = store.read_jsonl(spark, args.entities) if args.format == "jsonl" else store.read(spark, args.entities, args.format)
    return store.create_scoped(entities, args.root, store.scoped_query(args.query), args.keep)


if __name__ == "__main__":
    print(main())
