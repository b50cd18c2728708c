"""Samples of the run's processes: memory, CPU time and network, in the form that the dashboard reads."""

from __future__ import annotations

import os
import threading
import time
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


def _processes(top: int) -> list[int]:
    """The process and all below it."""
    children: dict[int, list[int]] = {}
    for entry in Path("/proc").iterdir():
        if entry.name.isdigit():
            try:
                parent = int((entry / "stat").read_text().rsplit(")", 1)[1].split()[1])
            except (OSError, IndexError, ValueError):
                continue
            children.setdefault(parent, []).append(int(entry.name))
    found, open_ = [], [top]
    while open_:
        pid = open_.pop()
        found.append(pid)
        open_ += children.get(pid, [])
    return found


def _usage(pid: int) -> tuple[int, int]:
    """Resident bytes and CPU nanoseconds of a process; zeros once it is gone."""
    try:
        stat = Path(f"/proc/{pid}/stat").read_text().rsplit(")", 1)[1].split()
        pages = int(Path(f"/proc/{pid}/statm").read_text().split()[1])
    except (OSError, IndexError, ValueError):
        return 0, 0
    ticks = int(stat[11]) + int(stat[12])
    return pages * os.sysconf("SC_PAGE_SIZE"), ticks * 10**9 // os.sysconf("SC_CLK_TCK")


def _network() -> tuple[int, int]:
    """Bytes received and sent over all interfaces."""
    received = sent = 0
    for line in Path("/proc/net/dev").read_text().splitlines()[2:]:
        numbers = line.split(":", 1)[1].split()
        received, sent = received + int(numbers[0]), sent + int(numbers[8])
    return received, sent


class StreamProgress(StreamingQueryListener):
    """The last micro-batch of the session's streams, and what they have done in all."""

    def __init__(self) -> None:
        self.last: dict | None = None
        self._late = self._rows = 0

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        done = event.progress
        self._rows += done.numInputRows
        self._late += sum(s.numRowsDroppedByWatermark for s in done.stateOperators)
        self.last = {
            "batch": done.batchId,
            "batch_ms": done.batchDuration,
            "input_rows": self._rows,
            "state_rows": sum(s.numRowsTotal for s in done.stateOperators),
            "late_rows": self._late,
        }

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        pass


class Sampler:
    """Samples this process and its children, and the progress of its streams, in a thread while it is open."""

    def __init__(self, case: str, name: str, interval: float = 1.0):
        self.case, self.name, self.interval, self.samples = case, name, interval, []
        self.progress = StreamProgress()
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def __enter__(self) -> Sampler:
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()
        # the end as well, which a short case has before its first sample
        self.samples.append(self.sample(self.samples[-1] if self.samples else None))

    def _run(self) -> None:
        while not self._stop.wait(self.interval):
            self.samples.append(self.sample(self.samples[-1] if self.samples else None))

    def sample(self, before: dict | None) -> dict:
        usage = [_usage(p) for p in _processes(os.getpid())]
        cpu = {
            "cpu_usage": {"total_usage": sum(c for _, c in usage)},
            "system_cpu_usage": time.monotonic_ns() * (os.cpu_count() or 1),
            "online_cpus": os.cpu_count() or 1,
        }
        received, sent = _network()
        return {
            "read": datetime.now(timezone.utc).isoformat(),
            "case": self.case,
            "container_name": self.name,
            "memory_stats": {"usage": sum(m for m, _ in usage)},
            "cpu_stats": cpu,
            "precpu_stats": before["cpu_stats"] if before else cpu,
            "networks": {"eth0": {"rx_bytes": received, "tx_bytes": sent}},
            "streams": self.progress.last,
        }
