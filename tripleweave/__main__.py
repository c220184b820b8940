"""The engine from the command line, by `python -m tripleweave` or spark-submit.

    query   MAPPING FILE.rq    the rows of a SPARQL query, tab-separated (--explain: Spark's plan instead)
    forward MAPPING PATH       the graph, as N-Triples, N-Quads or Turtle files
    bench   MAPPING FILE.yml   timings of named queries, a JSON line each
    parse   FILE.rq            the query as it was read

Tables come from --table NAME=PATH (Parquet, or by extension CSV with a header, JSON lines or ORC); others that the mapping names
are looked up in the session's catalog. --key NAME=COLUMN,... declares a key.
"""

from __future__ import annotations

import argparse
import json
import pathlib
import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from .engine import Catalog, Engine
from .functions.exprs import QueryError
from .mapping import MappingError, load_mapping
from .operators import rdf
from .sources import results
from .sparql import printer
from .sparql.parser import ParseError, parse


def _read(spark: SparkSession, path: str) -> DataFrame:
    kind = pathlib.PurePosixPath(path).suffix.lower().lstrip(".")
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    return getattr(spark.read, kind if kind in ("json", "orc") else "parquet")(path)


def _pair(text: str) -> tuple[str, str]:
    name, sign, value = text.partition("=")
    if not (name and sign and value):
        raise argparse.ArgumentTypeError(f"{text!r} isn't of the form NAME=VALUE")
    return name, value


def _engine(spark: SparkSession, args: argparse.Namespace) -> Engine:
    mapping = load_mapping(args.mapping, args.strict)
    for message in mapping.errors:
        print(f"{args.mapping}: {message}", file=sys.stderr)
    for name, path in args.table:
        _read(spark, path).createOrReplaceTempView(name)
    catalog = Catalog.from_spark(spark, mapping)
    for name, columns in args.key:
        catalog.declare_key(name, *columns.split(","))
    return Engine(spark, mapping, catalog)


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tripleweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(dest="command", required=True)
    shared = argparse.ArgumentParser(add_help=False)
    shared.add_argument("mapping", help="R2RML (.ttl) or YARRRML (.yml, .yaml, .yarrrml)")
    shared.add_argument("--table", type=_pair, action="append", default=[], metavar="NAME=PATH")
    shared.add_argument("--key", type=_pair, action="append", default=[], metavar="NAME=COLUMN,...")
    shared.add_argument("--strict", action="store_true", help="stop at a fault of the mapping, and at an IRI that can't be written")
    one = commands.add_parser("query", parents=[shared])
    one.add_argument("file")
    one.add_argument("--out", help="a folder to write to, instead of the screen")
    one.add_argument("--explain", action="store_true")
    one = commands.add_parser("forward", parents=[shared])
    one.add_argument("out")
    one.add_argument("--format", choices=("ntriples", "nquads", "turtle"), default="ntriples")
    one.add_argument("--distinct", action="store_true")
    one = commands.add_parser("bench", parents=[shared])
    one.add_argument("file")
    one.add_argument("--only", action="append", metavar="NAME")
    one.add_argument("--warm", type=int, default=1)
    one.add_argument("--runs", type=int, default=5)
    commands.add_parser("parse").add_argument("file")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """The exit code: 0, or 1 after a message if the mapping, the query or a file is at fault."""
    args = _arguments().parse_args(argv)
    try:
        if args.command == "parse":
            print(printer.query(parse(pathlib.Path(args.file).read_text(encoding="utf-8"))))
            return 0
        spark = spark or SparkSession.builder.appName("tripleweave").getOrCreate()
        engine = _engine(spark, args)
        if args.command == "forward":
            rdf.write(engine.quads(args.distinct, args.strict), args.out, args.format)
        elif args.command == "bench":
            from .harness import load_queries, measure

            found = load_queries(args.file)
            for line in measure(engine, {k: v for k, v in found.items() if not args.only or k in args.only}, args.warm, args.runs):
                print(json.dumps(line), flush=True)
        else:
            df = engine.query(pathlib.Path(args.file).read_text(encoding="utf-8"))
            if args.explain:
                df.explain("formatted")
            elif args.out:
                results.write(df, args.out)
            else:
                results.show(df)
    except (ParseError, QueryError, MappingError, PySparkException, OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
