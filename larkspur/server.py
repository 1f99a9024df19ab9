"""A line-based text server with challenge-response login, and its client.

A request is one line of JSON, {"sql": ...}; so is the answer, {"message"} or {"error"}. Rows come in one line or more,
{"columns", "rows", "more"}, until "more" is false: partition by partition, so a result of any size passes through a
driver that holds FRAME rows of it. Each connection is a session of its own, so transactions and temporary names do not mix. Login: the server sends a user's
salt and a nonce; the client answers with sha256(sha256(salt + password) + nonce). A nonce serves once, for ``nonce_s``
seconds; so many ``failures`` lock the user out for ``locked_s`` seconds.

    python -m larkspur.server --root FOLDER [--host H] [--port N] [--open]
"""

from __future__ import annotations

import argparse
import hashlib
import hmac
import json
import secrets
import socket
import socketserver
import threading
import time
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.lexer import SqlError
from larkspur.session import SUPERUSER, Session

NONCE_S, FAILURES, LOCKED_S, FRAME = 90, 3, 60, 10_000


def proof(salt: str, password: str, nonce: str) -> str:
    return hashlib.sha256((hashlib.sha256((salt + password).encode()).hexdigest() + nonce).encode()).hexdigest()


class Handler(socketserver.StreamRequestHandler):
    def handle(self):
        session = Session(self.server.spark, self.server.root, user=SUPERUSER if self.server.open else "")
        nonce = None
        for line in self.rfile:
            try:
                ask = json.loads(line)
                if "login" in ask:
                    user = ask["login"].upper()
                    if self.server.locked(user):
                        raise SqlError("locked out")
                    have = session.store.load()["users"].get(user, {"salt": hashlib.sha256(user.encode()).hexdigest()[:16], "hash": ""})
                    nonce = (user, secrets.token_hex(16), time.monotonic())
                    out = {"salt": have["salt"], "nonce": nonce[1]}
                elif "proof" in ask:
                    user, value, made = nonce or ("", "", 0)
                    nonce = None
                    have = session.store.load()["users"].get(user)
                    want = hashlib.sha256((have["hash"] + value).encode()).hexdigest() if have else ""
                    if not have or time.monotonic() - made > self.server.nonce_s or not hmac.compare_digest(want, str(ask["proof"])):
                        self.server.failed(user)
                        raise SqlError("wrong user or password")
                    session.user = user
                    out = {"message": f"logged in as {user}"}
                elif not session.user:
                    raise SqlError("log in first")
                else:
                    got = session.execute(ask["sql"])
                    if isinstance(got, DataFrame):
                        rows: list[list] = []
                        for row in got.toLocalIterator(prefetchPartitions=True):
                            if len(rows) == self.server.frame:
                                self.send({"columns": got.columns, "rows": rows, "more": True})
                                rows = []
                            rows.append(list(row))
                        out = {"columns": got.columns, "rows": rows, "more": False}
                    else:
                        out = {"message": got}
            except Exception as e:
                out = {"error": str(e)}
            self.send(out)

    def send(self, out: dict) -> None:
        self.wfile.write((json.dumps(out, default=str) + "\n").encode())


class Server(socketserver.ThreadingTCPServer):
    """``open``: connections are the superuser without a login (for a first start on a trusted machine)."""

    allow_reuse_address = daemon_threads = True

    def __init__(self, spark: SparkSession, root: str, port: int = 0, open: bool = False, host: str = "127.0.0.1", nonce_s: float = NONCE_S, failures: int = FAILURES, locked_s: float = LOCKED_S, frame: int = FRAME):
        self.spark, self.root, self.open, self.nonce_s, self.failures, self.locked_s, self.frame = spark, root, open, nonce_s, failures, locked_s, frame
        self.misses: dict[str, list[float]] = defaultdict(list)
        super().__init__((host, port), Handler)

    def locked(self, user: str) -> bool:
        return len([t for t in self.misses[user] if time.monotonic() - t < self.locked_s]) >= self.failures

    def failed(self, user: str) -> None:
        self.misses[user].append(time.monotonic())

    def start(self) -> int:
        """Serve in the background; the port."""
        threading.Thread(target=self.serve_forever, daemon=True).start()
        return self.server_address[1]


class Client:
    def __init__(self, port: int, host: str = "127.0.0.1"):
        self.socket = socket.create_connection((host, port))
        self.file = self.socket.makefile("rwb")

    def ask(self, **what) -> dict:
        self.file.write((json.dumps(what) + "\n").encode())
        self.file.flush()
        out = json.loads(self.file.readline())
        if "error" in out:
            raise SqlError(out["error"])
        return out

    def login(self, user: str, password: str) -> None:
        got = self.ask(login=user)
        self.ask(proof=proof(got["salt"], password, got["nonce"]))

    def execute(self, sql: str) -> dict:
        out = self.ask(sql=sql)
        more = out.get("more")
        while more:
            part = json.loads(self.file.readline())
            if "error" in part:
                raise SqlError(part["error"])
            out["rows"] += part["rows"]
            out["more"] = more = part["more"]
        return out

    def close(self) -> None:
        self.file.close()
        self.socket.close()


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="larkspur.server")
    p.add_argument("--root", required=True, help="the database's folder")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=7007)
    p.add_argument("--open", action="store_true", help="connections are the superuser without a login")
    a = p.parse_args(arguments)
    with Server(SparkSession.builder.appName("larkspur-server").getOrCreate(), a.root, a.port, a.open, a.host) as server:
        print(f"listening on {a.host}:{server.server_address[1]}", flush=True)
        server.serve_forever()


if __name__ == "__main__":
    main()
