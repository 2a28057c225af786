"""Settings files and calls of outside services."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

# Seconds to wait after a failed try, and after being refused.
WAITS = (2, 5, 10)
REFUSED_WAITS = (30, 60, 120)


def read_settings(path: str, environment: dict[str, str] | None = None) -> dict[str, str]:
    """``KEY=VALUE`` lines, comments and blank lines skipped; the environment takes precedence."""
    env = os.environ if environment is None else environment
    out: dict[str, str] = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, cut, value = line.strip().partition("=")
            if cut and key and not key.startswith("#"):
                out[key.strip()] = value.strip().strip("'\"")
    return {k: env.get(k, v) for k, v in out.items()}


def enrich(df: DataFrame, key: str, call: Callable[[dict], tuple[int, str]], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Call a service for each row: (key, status, text, reason); up to three tries, longer waits after a refusal (403).

    ``call`` gets the row as a dict and returns (HTTP status, text). Rows are
    called one after the other within a task; partitions bound how many run
    at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                status, text = 0, ""
                for k in range(3):
                    try:
                        status, text = call(row)
                    except OSError as e:
                        status, text = 0, str(e)
                    if status == 200:
                        break
                    if k < 2:
                        wait((REFUSED_WAITS if status == 403 else WAITS)[k])
                ok = status == 200
                rows.append((str(row[key]), "ok" if ok else "rejected", text if ok else None, None if ok else f"status {status} {text}".strip()))
            yield pd.DataFrame(rows, columns=["chunk", "status", "text", "reason"])

    return df.mapInPandas(run, "chunk string, status string, text string, reason string")
