"""A prompt over a store: `python -m asserta.cli PATH`. Queries, transactions, `test`, `dump`, `quit`."""

from __future__ import annotations

import sys
import time

from pyspark.sql import DataFrame, SparkSession

from asserta.db import Connection
from asserta.functions.render import table
from asserta.model import FactError, TxReport


def answer(connection: Connection, line: str) -> str:
    began = time.time()
    try:
        got = connection.run(line)
    except FactError as e:
        return f"error: {e}"
    if isinstance(got, DataFrame):
        text = table(got)
        return f"{text}\n{1000 * (time.time() - began):.0f} ms"
    if isinstance(got, TxReport):
        return f"transaction {got.tx}, new entities {list(got.new_entities)}" if got.ok else f"error: {got.error}"
    return "sample loaded"


def main(arguments: list[str]) -> int:
    if len(arguments) != 1:
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("asserta").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    connection = Connection(spark, arguments[0])
    try:
        for line in sys.stdin:
            if line.strip() == "quit":
                break
            print(answer(connection, line.strip()), flush=True)
    finally:
        connection.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
