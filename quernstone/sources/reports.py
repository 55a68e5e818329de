"""Small results for people: Markdown tables, JSON manifests. For tables of report size, which are collected."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame

#: Rows a report table may have.
MOST_ROWS = 1000
#: Points a frontier may have as JSON.
MOST_POINTS = 100_000


def share(part: int, whole: int) -> str:
    return f"{part / whole:.2%}" if whole else "n/a"


def markdown(df: DataFrame) -> str:
    """The first column aligned left, the others right; more than ``MOST_ROWS`` rows raise."""
    rows = df.limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError("too many rows for a report")
    lines = [df.columns, ["---", *["---:"] * (len(df.columns) - 1)], *[["" if v is None else str(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def manifest(facts: dict[str, Any]) -> str:
    return json.dumps(facts, indent=2, sort_keys=True, default=str)


def points_json(points: DataFrame) -> str:
    """Points of a frontier as JSON, by descending threshold; more than ``MOST_POINTS`` raise."""
    rows = points.orderBy(points["tau"].desc()).limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError("too many points for a report")
    return json.dumps([r.asDict() for r in rows])
