"""Timing of SPARQL queries over a mapping: planning (parsing, unfolding, Catalyst) and execution (all rows drained) apart."""

from __future__ import annotations

import statistics
import time
from collections.abc import Iterator

from pyspark.sql import Observation
from pyspark.sql import functions as F

from .engine import Engine


def load_queries(path: str) -> dict[str, str]:
    """A YAML file that maps names to SPARQL texts."""
    import pathlib

    import yaml

    found = yaml.safe_load(pathlib.Path(path).read_text(encoding="utf-8"))
    if not isinstance(found, dict) or not all(isinstance(v, str) for v in found.values()):
        raise ValueError(f"{path} must map names to SPARQL texts")
    return {str(k): v for k, v in found.items()}


def _spread(seconds: list[float]) -> dict[str, float]:
    ms = [round(1000 * s, 1) for s in seconds]
    return {"min": min(ms), "median": round(statistics.median(ms), 1), "max": max(ms)}


def _once(engine: Engine, text: str) -> tuple[float, float, int]:
    start, rows = time.perf_counter(), Observation()
    df = engine.query(text)
    df._jdf.queryExecution().executedPlan()
    planned = time.perf_counter()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.format("noop").mode("overwrite").save()
    return planned - start, time.perf_counter() - planned, rows.get["n"]


def measure(engine: Engine, queries: dict[str, str], warm: int = 1, runs: int = 5) -> Iterator[dict]:
    """For each query {query, rows, planning_ms, execution_ms} (min, median and max of `runs` runs that follow `warm` others),
    or {query, error}: a query that fails doesn't end the rest."""
    for name, text in queries.items():
        try:
            found = [_once(engine, text) for _ in range(warm + max(1, runs))][warm:]
        except Exception as e:  # noqa: BLE001
            yield {"query": name, "error": f"{type(e).__name__}: {e}".split("\n")[0]}
            continue
        yield {"query": name, "rows": found[-1][2], "planning_ms": _spread([f[0] for f in found]), "execution_ms": _spread([f[1] for f in found])}
