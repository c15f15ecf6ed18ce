"""Console: prepare, scan, assign, load, query, stat over folders of triples."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from graphloom.graph import Graph, Settings
from graphloom.operators import schema


def main() -> None:
    parser = argparse.ArgumentParser(prog="graphloom")
    parser.add_argument("command", choices=["prepare", "scan", "assign", "encode", "load", "query", "stat"])
    parser.add_argument("source", help="N-Triples text for prepare, scan, assign, encode and load; a saved graph for query and stat")
    parser.add_argument("target", nargs="?", help="output folder, or a query file")
    parser.add_argument("--sep", default=" ")
    parser.add_argument("--fold-types", action="store_true")
    parser.add_argument("--max-types", type=int)
    parser.add_argument("--mode", default="reference")
    parser.add_argument("--encoded", action="store_true", help="query: match on ids")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    settings = Settings(args.fold_types, args.max_types, args.sep.replace("\\t", "\t"))
    if args.command in ("query", "stat"):
        graph = Graph.load(spark, args.source, settings, args.encoded)
        if args.command == "stat":
            spark.read.parquet(f"{args.source}/statistics").show(50, False)
            return
        with open(args.target) as f:
            found = graph.solutions(f.read(), mode=args.mode)
        began = time.perf_counter()
        n = found.count()
        print(f"{n} rows, {1000 * (time.perf_counter() - began):.0f} ms")
        print(found.brief(10))
        return
    graph = Graph.from_ntriples(spark, args.source, settings)
    if args.command == "prepare":
        from graphloom.sources.ntriples import paired

        paired(graph.triples()).write.parquet(args.target)
    elif args.command == "scan":
        graph.types().write.parquet(args.target)
    elif args.command == "assign":
        schema.dictionary(graph.triples(), graph.types(), settings.fold_types).write.parquet(args.target)
    elif args.command == "encode":
        schema.encode(graph.triples(), schema.dictionary(graph.triples(), graph.types(), settings.fold_types), schema.predicate_ids(graph.triples())).write.parquet(args.target)
    else:
        graph.save(args.target)


if __name__ == "__main__":
    main()
