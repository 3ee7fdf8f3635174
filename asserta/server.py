"""A transactor: one process that writes, and takes transactions from others over TCP.

`python -m asserta.server --uri URI [--create] [--host HOST] [--port PORT]`. A request is a line with a transaction's
text as a JSON string; the answer is a line with a JSON object: tx and new_entities, or error. Transactions are done
one after the other; readers need no transactor."""

from __future__ import annotations

import argparse
import json
import socket
import socketserver
import sys
import threading

from pyspark.sql import SparkSession

from asserta.db import Connection, Db
from asserta.model import FactError, TxReport

PORT = 10405


class TransactorService:
    def __init__(self, connection: Connection):
        self.connection, self.turn, self.server = connection, threading.Lock(), None

    def answer(self, line: str) -> str:
        try:
            with self.turn:
                report = self.connection.transact(json.loads(line))
        except Exception as e:  # the service goes on, and the sender is told
            report = TxReport(error=e)
        return json.dumps({"tx": report.tx, "new_entities": list(report.new_entities)} if report.ok else {"error": str(report.error)})

    def listen(self, host: str = "127.0.0.1", port: int = PORT) -> tuple[str, int]:
        """Serves in threads of its own; the address."""
        service = self

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                for line in self.rfile:
                    self.wfile.write(f"{service.answer(line.decode())}\n".encode())

        socketserver.ThreadingTCPServer.allow_reuse_address = True
        self.server = socketserver.ThreadingTCPServer((host, port), Handler)
        self.server.daemon_threads = True
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self.server.server_address[:2]

    def close(self) -> None:
        if self.server:
            self.server.shutdown()
            self.server.server_close()
        with self.turn:
            self.connection.close()


class RemoteConnection:
    """Reads the store itself and sends transactions to a transactor."""

    def __init__(self, spark: SparkSession, uri: str, address: tuple[str, int]):
        self.reader = Connection(spark, uri)
        self.socket = socket.create_connection(address)
        self.lines = self.socket.makefile("rw", encoding="utf-8")

    def db(self) -> Db:
        return self.reader.db()

    def transact(self, text: str) -> TxReport:
        self.lines.write(json.dumps(text) + "\n")
        self.lines.flush()
        said = json.loads(self.lines.readline())
        return TxReport(error=FactError(said["error"])) if "error" in said else TxReport(said["tx"], tuple(said["new_entities"]))

    def close(self) -> None:
        self.lines.close()
        self.socket.close()


def main(arguments: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="asserta.server", description="A transactor for a store.")
    parser.add_argument("-u", "--uri", required=True)
    parser.add_argument("-c", "--create", action="store_true", help="make the database if there is none")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=PORT)
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("asserta-transactor").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    connection = Connection(spark, asked.uri)
    if connection.store.manifest() is None and not asked.create:
        print(f"{asked.uri} has no database; --create makes one", file=sys.stderr)
        return 1
    service = TransactorService(connection)
    print("listening on {}:{}".format(*service.listen(asked.host, asked.port)), flush=True)
    try:
        threading.Event().wait()
    except KeyboardInterrupt:
        service.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
