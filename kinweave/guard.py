"""Run a command and stop it when it says nothing for too long or takes too long."""

from __future__ import annotations

import queue
import subprocess
import sys
import threading
import time
from dataclasses import dataclass


@dataclass(frozen=True)
class Outcome:
    """How a command ended. reason: finished, failed, stalled or timeout."""

    reason: str
    code: int | None
    lines: list[str]


def guarded(command: list[str], *, stall_seconds: float = 600, total_seconds: float = 7200, keep: int = 200, echo: bool = False) -> Outcome:
    """Run command; its last `keep` lines are kept. A line of output shows that it goes on."""
    process = subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.STDOUT, text=True, errors="replace")
    said: queue.Queue[str | None] = queue.Queue()

    def listen() -> None:
        for line in process.stdout:
            said.put(line.rstrip("\n"))
        said.put(None)

    threading.Thread(target=listen, daemon=True).start()
    lines: list[str] = []
    began, reason = time.monotonic(), ""
    while not reason:
        left = began + total_seconds - time.monotonic()
        try:
            line = said.get(timeout=max(0.01, min(stall_seconds, left)))
        except queue.Empty:
            reason = "timeout" if time.monotonic() - began >= total_seconds else "stalled"
            process.kill()
            break
        if line is None:
            break
        lines = [*lines, line][-keep:]
        if echo:
            print(line, flush=True)
    code = process.wait()
    return Outcome(reason or ("finished" if code == 0 else "failed"), code, lines)


def guarded_notebook(path: str, output: str, **limits: float) -> Outcome:
    """Execute a notebook with jupyter nbconvert, where that is installed."""
    return guarded([sys.executable, "-m", "jupyter", "nbconvert", "--to", "notebook", "--execute", path, "--output", output], **limits)
