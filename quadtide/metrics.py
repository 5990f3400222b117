"""Memory of the driver process over time. Executors' figures are in Spark's own metrics."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field


def resident_bytes() -> int:
    """Resident memory of this process; 0 where the system doesn't tell."""
    try:
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    except (OSError, ValueError, IndexError):
        return 0


@dataclass
class MemoryTracker:
    samples: list[tuple[float, int, str]] = field(default_factory=list)
    most: int = 10_000

    def sample(self, label: str = "") -> int:
        now = resident_bytes()
        self.samples.append((time.time(), now, label))
        del self.samples[: -self.most]
        return now

    def summary(self) -> dict:
        sizes = [s for _, s, _ in self.samples]
        if not sizes:
            return {"samples": 0, "current": 0, "peak": 0, "mean": 0}
        return {"samples": len(sizes), "current": sizes[-1], "peak": max(sizes), "mean": sum(sizes) // len(sizes)}
