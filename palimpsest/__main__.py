"""python -m palimpsest PATH COMMAND [TEXT...]: the library at a path, from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .library import COMMANDS, Library
from .schema import MEMORY_TYPES


#: Commands that leave a line in the log.
LOGGED = {"store": "STORE", "batch": "STORE", "import": "STORE", "recall": "RECALL", "search": "SEARCH", "delete": "DELETE", "sleep": "SLEEP", "dream": "DREAM", "merge": "MERGE"}


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="palimpsest")
    p.add_argument("path")
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("text", nargs="*")
    p.add_argument("--tags", nargs="*", default=[])
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--threshold", type=float)
    p.add_argument("--regex")
    p.add_argument("--fuzzy")
    p.add_argument("--type", choices=MEMORY_TYPES)
    p.add_argument("--form", choices=("json", "dot", "mermaid", "html"), default="json")
    p.add_argument("--hour", type=int, default=12)
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("palimpsest").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    library = Library(spark, a.path)
    out = COMMANDS[a.command](library, a)
    if (op := LOGGED.get(a.command)) is not None:
        library.log(op, " ".join(a.text), a.tags)
    if out is not None:
        out.show(max(a.limit, 20), truncate=100)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
