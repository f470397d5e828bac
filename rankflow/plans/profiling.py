"""Timing of actions and the shape of plans."""

from __future__ import annotations

import re
import time
from collections import Counter, defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Profiler:
    """Sums, maxima and counts of named phases, and their shares of all time."""

    seconds: dict[str, list[float]] = field(default_factory=lambda: defaultdict(list))

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter_ns()
        try:
            yield
        finally:
            self.seconds[name].append((time.perf_counter_ns() - began) / 1e9)

    def report(self) -> list[dict]:
        total = sum(map(sum, self.seconds.values())) or 1.0
        return [{"phase": n, "sum": sum(x), "max": max(x), "count": len(x), "share": sum(x) / total} for n, x in self.seconds.items()]


def plan_nodes(df: DataFrame) -> Counter:
    """How often each physical operator occurs in the plan."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return Counter(re.findall(r"^[\s:+\-*()\d]*([A-Z]\w+)", text, re.M))


def work_and_span(tasks: dict[str, list[float]], after: dict[str, list[str]]) -> tuple[float, float]:
    """Work (all task seconds) and span (longest path of stages, each as long as its longest task)."""
    spans: dict[str, float] = {}

    def span(stage: str) -> float:
        if stage not in spans:
            spans[stage] = max(tasks[stage], default=0.0) + max((span(s) for s in after.get(stage, [])), default=0.0)
        return spans[stage]

    return sum(map(sum, tasks.values())), max((span(s) for s in tasks), default=0.0)
