"""Settings and results of a benchmark run."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace
from pathlib import Path
from typing import Any


class BenchmarkError(Exception):
    """A run that cannot be set up or counted."""


@dataclass(frozen=True)
class RunConfig:
    """How a run is sized. With paced, streams get event_rate events a second instead of all there are."""

    cpu_cores: float = 2.0
    memory_limit: str = "4g"
    data_size: int = 10_000_000
    event_rate: int = 300_000
    paced: bool = False
    generators: int = 3
    stats_interval: float = 1.0
    shuffle_partitions: int | None = None

    def spark_conf(self) -> dict[str, str]:
        cores = max(1, int(self.cpu_cores))
        return {
            "spark.master": f"local[{cores}]",
            "spark.driver.memory": self.memory_limit,
            "spark.sql.shuffle.partitions": str(self.shuffle_partitions or cores),
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.ui.enabled": "false",
        }


def load_config(file: str | None, given: dict[str, Any]) -> RunConfig:
    """Defaults, then the file's settings, then those given on the command line (not None). Unknown keys in the file are left out."""
    names = {f.name for f in fields(RunConfig)}
    settings: dict[str, Any] = {}
    if file:
        try:
            settings = json.loads(Path(file).read_text())
        except (OSError, ValueError) as error:
            raise BenchmarkError(f"cannot read settings from {file}: {error}") from error
    chosen = {k: v for k, v in settings.items() if k in names}
    chosen |= {k: v for k, v in given.items() if k in names and v is not None}
    return replace(RunConfig(), **chosen)


@dataclass
class CaseResult:
    """One case on one mode: seconds, rows, and what went wrong if anything did."""

    case: str
    platform: str
    execution_time: float
    output_size: int
    error: str | None = None
    stats: list[dict] | None = None

    def row(self) -> dict[str, Any]:
        return {k: v for k, v in asdict(self).items() if k != "stats"}
