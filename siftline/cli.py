"""Command line: python -m siftline.cli create-index | convert-json | search."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession

from .operators import search
from .operators.index import Index
from .plans import generator
from .sources import readers


def _arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftline")
    commands = top.add_subparsers(dest="command", required=True)
    create = commands.add_parser("create-index", help="index a file of JSON documents, one a line")
    create.add_argument("-d", "--data", required=True)
    create.add_argument("-t", "--target", required=True)
    create.add_argument("-c", "--config", help="file with field settings, TOML or JSON")
    convert = commands.add_parser("convert-json", help="one document a line from a JSON array or from objects in a row")
    convert.add_argument("--input", required=True)
    convert.add_argument("--output", required=True)
    find = commands.add_parser("search", help="search a saved index by a request in JSON or by URL parameters")
    find.add_argument("index")
    find.add_argument("request")
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = _arguments().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("siftline").getOrCreate()
    if args.command == "create-index":
        config = Path(args.config).read_text(encoding="utf-8") if args.config else None
        Index.from_file(spark, args.data, config).save(args.target)
    elif args.command == "convert-json":
        readers.write_json_lines(readers.read_json_array(spark, args.input), args.output)
    else:
        wanted = args.request if args.request.lstrip().startswith("{") else generator.search_params(args.request)
        for row in search.search(Index.load(spark, args.index), wanted).data.collect():
            print(json.dumps({"doc_id": row["doc_id"], "score": row["score"], "doc": json.loads(row["doc"])}, ensure_ascii=False))


if __name__ == "__main__":
    main()
