"""python -m lodestrata.server PATH: a search server on a Unix socket, one session and one index for many clients.

A request is a line of JSON: {"pattern": ...}, or {"ping": true}. The answer is a line of
JSON: {"matches": [...], "count": n}, {"status": "ok"} or {"error": ...}. Readers use the
snapshot that was current when they began; a refresh makes a new one and then swaps it in.
"""

from __future__ import annotations

import argparse
import json
import os
import resource
import signal
import socketserver
import subprocess
import sys
import threading
import time
from pathlib import Path

from pyspark.sql import SparkSession
from .cli import Corpus
from .plans.regex import PatternError
from .sources import directory

IDLE_S = 30 * 60
MOST_RSS_MB = 500
QUIET_S = 0.5


class Server:
    """Serves a tree; stops after idle_s without a request, or beyond most_rss_mb of Python's memory."""

    def __init__(self, spark: SparkSession, root: str, socket_path: str, idle_s: float = IDLE_S, most_rss_mb: float = MOST_RSS_MB, index: str | None = None):
        self.spark, self.root, self.socket_path = spark, root, socket_path
        self.index = index or "file://" + os.path.abspath(socket_path + ".index")
        self.idle_s, self.most_rss_mb = idle_s, most_rss_mb
        self.touched = time.monotonic()
        self.corpus = self._read()
        self.seen = self._listing()
        self._stop = threading.Event()

    def _read(self) -> Corpus:
        """A new snapshot of the index; only new and changed files are read for it, and the snapshot before last is deleted."""
        return Corpus.of_tree(self.spark, self.root, self.index)

    def _listing(self) -> set:
        return set(directory.walk(self.root))

    def refresh(self) -> set[str]:
        """Take in what has changed in the tree; the paths."""
        now = self._listing()
        changed = {p for p, _, _ in now ^ self.seen}
        if changed:
            self.corpus, self.seen = self._read(), now
        return changed

    def watch(self) -> None:
        """Refresh after each burst of changes, once nothing has changed for QUIET_S."""
        last = self.seen
        while not self._stop.wait(QUIET_S):
            now = self._listing()
            if now == last and now != self.seen:
                self.refresh()
            last = now

    def reply(self, line: str) -> dict:
        self.touched = time.monotonic()
        try:
            asked = json.loads(line)
            if asked.get("ping"):
                return {"status": "ok"}
            found = [r.asDict() for r in self.corpus.search(asked["pattern"]).collect()]
            return {"matches": found, "count": len(found)}
        except (ValueError, KeyError, AttributeError, PatternError) as e:
            return {"error": f"{type(e).__name__}: {e}"}

    def run(self) -> None:
        outer = self

        class Handler(socketserver.StreamRequestHandler):
            def handle(self):
                for raw in self.rfile:
                    self.wfile.write(json.dumps(outer.reply(raw.decode("utf-8", "replace"))).encode() + b"\n")
                    self.wfile.flush()

        Path(self.socket_path).unlink(missing_ok=True)
        with socketserver.ThreadingUnixStreamServer(self.socket_path, Handler) as server:
            server.daemon_threads = True
            os.chmod(self.socket_path, 0o600)
            pid = Path(self.socket_path + ".pid")
            pid.write_text(str(os.getpid()))
            threads = [threading.Thread(target=f, daemon=True) for f in (server.serve_forever, self.watch)]
            for t in threads:
                t.start()
            while not self._stop.wait(0.2):
                rss = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
                if time.monotonic() - self.touched > self.idle_s or rss > self.most_rss_mb:
                    self._stop.set()
            server.shutdown()
            Path(self.socket_path).unlink(missing_ok=True)
            pid.unlink(missing_ok=True)

    def stop(self) -> None:
        self._stop.set()


def status(socket_path: str) -> int | None:
    """The process that serves this socket, if it is alive."""
    try:
        pid = int(Path(socket_path + ".pid").read_text())
        os.kill(pid, 0)
        return pid
    except (OSError, ValueError):
        return None


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodestrata.server", description=__doc__.split("\n", 1)[0])
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("--socket", help="default: .lodestrata.sock in the tree")
    p.add_argument("--index", metavar="FOLDER")
    p.add_argument("--idle-timeout", type=float, default=IDLE_S, metavar="SECONDS")
    p.add_argument("--max-rss", type=float, default=MOST_RSS_MB, metavar="MB")
    p.add_argument("--background", action="store_true")
    p.add_argument("--status", action="store_true")
    p.add_argument("--stop", action="store_true")
    a = p.parse_args(args)
    at = a.socket or os.path.join(a.path, ".lodestrata.sock")
    pid = status(at)
    if a.status or a.stop:
        if pid and a.stop:
            os.kill(pid, signal.SIGTERM)
        print(f"{'stopping' if a.stop else 'running'}: {pid}" if pid else "not running")
        return 0 if pid else 1
    if pid:
        print(f"running: {pid}", file=sys.stderr)
        return 1
    if a.background:
        own = [x for x in (sys.argv[1:] if args is None else args) if x != "--background"]
        child = subprocess.Popen([sys.executable, "-m", "lodestrata.server", *own], stdin=subprocess.DEVNULL, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
        print(child.pid)
        return 0
    spark = SparkSession.builder.appName("lodestrata").config("spark.ui.enabled", "false").getOrCreate()
    server = Server(spark, a.path, at, a.idle_timeout, a.max_rss, a.index)
    signal.signal(signal.SIGTERM, lambda *_: server.stop())
    server.run()
    return 0


if __name__ == "__main__":
    sys.exit(main())
