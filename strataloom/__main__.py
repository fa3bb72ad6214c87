"""python -m strataloom index|search|context|watch|status|health|doctor|clean ROOT [QUERY]; the index lies in ROOT/.strataloom."""

from __future__ import annotations

import argparse
import json
import os
import shutil

from pyspark.sql import SparkSession

from strataloom import index, service
from strataloom.operators.embed import hashed_words
from strataloom.session import ship
from strataloom.streaming.watch import watch


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="strataloom", description=__doc__)
    p.add_argument("command", choices=["index", "search", "context", "watch", "status", "health", "doctor", "clean"])
    p.add_argument("root")
    p.add_argument("query", nargs="?", default="")
    p.add_argument("--force", action="store_true")
    p.add_argument("--verify", action="store_true")
    p.add_argument("--history", action="store_true")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--max-tokens", type=int, default=4096)
    a = p.parse_args(argv)
    at = os.path.join(os.path.abspath(a.root), ".strataloom")
    if a.command == "clean":
        shutil.rmtree(at, ignore_errors=True)
        return
    spark = SparkSession.builder.appName("strataloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    if a.command == "index":
        out = index.build_index(spark, a.root, at, force=a.force, verify=a.verify, history=a.history)
    elif a.command == "search":
        print(service.format_hits(service.search(spark, a.root, a.query, hashed_words(64), a.limit)))
        return
    elif a.command == "context":
        out = service.build_context(spark, a.root, a.query, hashed_words(64), a.max_tokens)
    elif a.command == "watch":
        watch(spark, a.root, lambda: index.build_index(spark, a.root, at, history=a.history))
        return
    elif a.command == "status":
        out = index.status(spark, at, a.root)
    else:
        out = index.health(spark, at)
    print(json.dumps(out, indent=2, default=str))


if __name__ == "__main__":
    main()
