"""A prompt for statements. Lines gather until a semicolon; commands begin with an exclamation mark."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from millrace.errors import EngineError
from millrace.results import Query, Result
from millrace.session import Engine, Session
from millrace.sources import external

HELP = """!headers on|off   column names above rows
!help             this text
!status           state of the engine
!table NAME       a table's definition
!tables           names of tables"""


def describe(r: Result, headers: bool) -> list[str]:
    if isinstance(r, Query):
        return r.lines(headers)
    return {
        "begin": [f"Began transaction {r.version}"], "commit": [f"Committed transaction {r.version}"], "rollback": [f"Rolled back transaction {r.version}"],
        "create": [f"Created {r.count} rows"], "update": [f"Updated {r.count} rows"], "delete": [f"Deleted {r.count} rows"],
        "create_table": [f"Created table {r.name}"], "drop_table": [f"Dropped table {r.name}"], "explain": r.text.splitlines(),
    }[r.kind]


class Prompt:
    def __init__(self, session: Session):
        self.session, self.headers, self.held = session, False, ""

    def feed(self, line: str) -> list[str]:
        """What a line prints."""
        try:
            if not self.held and line.startswith("!"):
                return self.command(*line[1:].split())
            self.held += line + "\n"
            if not line.rstrip().endswith(";"):
                return []
            sql, self.held = self.held, ""
            return describe(self.session.execute(sql), self.headers)
        except EngineError as e:
            return [f"Error: {e}"]

    def command(self, name: str = "", *args: str) -> list[str]:
        if name == "headers":
            self.headers = args[:1] != ("off",)
            return [f"Headers {'on' if self.headers else 'off'}"]
        if name == "status":
            return [f"{k}: {v}" for k, v in self.session.status().items()]
        if name == "table" and args:
            return self.session.get_table(args[0]).ddl().splitlines()
        if name == "tables":
            return self.session.list_tables()
        return HELP.splitlines() if name == "help" else [f"Unknown command !{name}"]


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root", help="folder of the database")
    p.add_argument("--external", help="folder of <name>.parquet that may be read, too")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    prompt = Prompt(Engine(spark, a.root, external.folder(spark, a.external) if a.external else None).session())
    for line in sys.stdin:
        for text in prompt.feed(line.rstrip("\n")):
            print(text)


if __name__ == "__main__":
    main()
