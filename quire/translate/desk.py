"""What the workers of a job share: pace, the model in turn, usage, finished batches, cancelling.

The driver keeps one Desk a job and serves it on a socket; a worker asks it before every call. So one
ceiling holds for all tasks together, a model that one finds spent is spent for all, and a batch that
is finished is kept by the driver at once: a task that runs again after a lost executor gets its
answers from the desk and pays for nothing twice. What passes through the desk is bounded by the rate
at which the service answers, not by the corpus.
"""

from __future__ import annotations

import hmac
import json
import secrets
import socket
import socketserver
import tempfile
import threading
import time
from collections import deque
from collections.abc import Callable

from quire.operators.requests import FLASH, LITE

#: Lines of a job's log that are kept for whoever asks late.
LOG_LINES = 41


def requests_per_minute(model: str) -> int:
    return 500 if "lite" in model else 20


def turn_of(model: str) -> list[str]:
    """The model, then those of its tier that follow it, going round; an unknown one is followed by its whole tier."""
    tier = LITE if "lite" in model else FLASH
    k = tier.index(model) + 1 if model in tier else 0
    return [model, *tier[k:], *tier[: max(k - 1, 0)]]


class Pace:
    """Books the starts of calls to one model.

    slowness is what the regular gap is multiplied by: a refusal doubles it, up to 4; twenty calls in
    a row without one win back a quarter of what it is above 1.
    """

    def __init__(self, per_minute: int):
        self.gap = max(60_000 // max(per_minute, 1), 1) / 1000
        self.slowness, self.clean, self.free = 1.0, 0, float("-inf")

    def book(self, now: float) -> float:
        """Seconds from now to the start that the caller has got."""
        start = max(now, self.free)
        self.free = start + self.gap * self.slowness
        return start - now

    def refused(self, now: float, pause: float) -> None:
        self.slowness, self.clean = min(2 * self.slowness, 4.0), 0
        self.free = max(self.free, now + pause)

    def went_well(self) -> None:
        self.clean += 1
        if self.clean >= 20 and self.slowness > 1:
            self.slowness, self.clean = 1 + 0.75 * (self.slowness - 1), 0


class Desk:
    """Thread-safe; times are epoch seconds. With switch=False a spent model has no successor."""

    def __init__(self, model: str, switch: bool = True, spent: tuple[str, ...] = (), total: int = 0, clock: Callable[[], float] = time.time):
        self.lock, self.clock, self.switch = threading.RLock(), clock, switch
        self.turn, self.paces = turn_of(model) if switch else [model], {}
        self.gone, self.day = set(spent), self._day()
        self.cancelled, self.stopped = False, False
        self.calls: list[tuple[float, str, bool]] = []
        self.counts = {"total": total, "done": 0, "failed": 0, "cached": 0, "tokens": 0}
        self.error: str | None = None
        self.log: deque[tuple[int, float, str]] = deque(maxlen=LOG_LINES)
        self.lines, self.unsaved = 0, []
        self.spool, self.places = tempfile.TemporaryFile(), {}

    def _day(self) -> int:
        return int(self.clock() + 57600) // 86400

    # ------------------------------------------------------------ what workers ask

    def model(self) -> str | None:
        """The model in use; None where the job must not go on."""
        with self.lock:
            if self.cancelled or self.stopped:
                return None
            if self.day != self._day():
                self.day = self._day()
                self.gone.clear()
            return next((m for m in self.turn if m not in self.gone), None)

    def book(self, model: str) -> float:
        with self.lock:
            return self._pace(model).book(self.clock())

    def _pace(self, model: str) -> Pace:
        return self.paces.setdefault(model, Pace(requests_per_minute(model)))

    def refused(self, model: str, pause: float) -> None:
        with self.lock:
            self._pace(model).refused(self.clock(), pause)

    def went_well(self, model: str) -> None:
        with self.lock:
            self._pace(model).went_well()

    def sent(self, model: str) -> None:
        """The service took a call: it counts against the quota, whatever the reply is worth."""
        with self.lock:
            self.calls.append((self.clock(), model, False))

    def spent(self, model: str, confirmed: bool) -> str | None:
        """A model's quota is gone; the model to go on with. A confirmed end is kept in the usage."""
        with self.lock:
            if model not in self.gone:
                self.gone.add(model)
                # the model after a spent one is its successor, not the first of the tier
                k = self.turn.index(model) if model in self.turn else -1
                self.turn = self.turn[k + 1 :] + self.turn[: k + 1]
                self.note(f"{model}: today's quota is spent")
            if confirmed:
                self.calls.append((self.clock(), model, True))
            return self.model()

    def finished(self, key: list, answers: list, outcome: str, tokens: int, cached: int, error: str, log: str | None = None) -> None:
        """Keep a batch: answers are (place..., text, model). A repeated one (its task ran twice) changes nothing."""
        with self.lock:
            name = tuple(key)
            if name in self.places:
                return
            if outcome == "cancelled":
                return
            if outcome == "done":
                raw = json.dumps(answers).encode()
                at = self.spool.seek(0, 2)
                self.spool.write(raw)
                self.places[name] = (at, len(raw))
                self.unsaved.append((log, key[1], answers))
                self.counts["tokens"] += tokens
            else:
                self.counts["failed"] += 1
                self.error = self.error or error
                self.stopped = self.stopped or outcome == "fatal"
            self.counts["done"] += 1
            self.counts["cached"] += cached
            self.note(f"batch {self.counts['done']} of {self.counts['total']}: {outcome}" + (f" ({error})" if error else ""))

    def kept(self, key: list) -> list | None:
        """The answers of a batch that has been finished already."""
        with self.lock:
            if tuple(key) not in self.places:
                return None
            at, n = self.places[tuple(key)]
            self.spool.seek(at)
            return json.loads(self.spool.read(n))

    def note(self, line: str) -> None:
        with self.lock:
            self.lines += 1
            self.log.append((self.lines, self.clock(), line))

    # ------------------------------------------------------------ what the driver does

    def cancel(self) -> None:
        with self.lock:
            self.cancelled = True
            self.note("cancelled")

    def take_unsaved(self) -> list:
        with self.lock:
            out, self.unsaved = self.unsaved, []
            return out

    def snapshot(self) -> dict:
        with self.lock:
            return {**self.counts, "error": self.error, "model": self.model(), "cancelled": self.cancelled}


ASKED = frozenset(("model", "book", "refused", "went_well", "sent", "spent", "finished", "kept"))


class Served:
    """A desk on a socket: one JSON request a line, each with the job's secret."""

    def __init__(self, desk: Desk, host: str):
        secret = secrets.token_hex(16)

        class Handler(socketserver.StreamRequestHandler):
            def handle(self) -> None:
                for line in self.rfile:
                    ask = json.loads(line)
                    if not hmac.compare_digest(str(ask.get("secret")), secret) or ask["what"] not in ASKED:
                        return
                    value = getattr(desk, ask["what"])(*ask["args"])
                    self.wfile.write(json.dumps(value).encode() + b"\n")

        class Server(socketserver.ThreadingTCPServer):
            daemon_threads, allow_reuse_address = True, True

        self.server = Server(("", 0), Handler)
        self.address = (host, self.server.server_address[1], secret)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def close(self) -> None:
        self.server.shutdown()
        self.server.server_close()


class RemoteDesk:
    """A worker's end."""

    def __init__(self, address: tuple[str, int, str]):
        host, port, self.secret = address
        self.stream = socket.create_connection((host, port), timeout=60).makefile("rwb")

    def __getattr__(self, what: str) -> Callable:
        if what not in ASKED:
            raise AttributeError(what)

        def ask(*args):
            self.stream.write(json.dumps({"secret": self.secret, "what": what, "args": args}).encode() + b"\n")
            self.stream.flush()
            reply = self.stream.readline()
            if not reply:
                raise ConnectionError("the job's driver is gone")
            return json.loads(reply)

        return ask

    def close(self) -> None:
        self.stream.close()
