"""Recipes: steps of named operations with ``{{placeholders}}``, run for each plot."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import SparkSession

from . import catalogue


def fill(value: Any, known: dict[str, Any]) -> Any:
    if isinstance(value, str):
        if m := re.fullmatch(r"\{\{\s*(\w+)\s*\}\}", value):
            return known[m[1]]
        return re.sub(r"\{\{\s*(\w+)\s*\}\}", lambda m: str(known[m[1]]), value)
    if isinstance(value, dict):
        return {k: fill(v, known) for k, v in value.items()}
    return [fill(v, known) for v in value] if isinstance(value, list) else value


def run_recipe(spark: SparkSession, recipe: dict, plots: list[dict]) -> list[dict]:
    """Names are checked before anything runs. A failed step ends its plot, unless it is optional; ``dataset`` follows what a step makes."""
    if unknown := [s["op"] for s in recipe["steps"] if s["op"] not in catalogue.OPS]:
        raise KeyError(f"unknown operations: {unknown}")
    report = []
    for plot in plots:
        known, steps = dict(plot), []
        for s in recipe["steps"]:
            try:
                got = catalogue.run(spark, s["op"], fill(s.get("params", {}), known))
                steps.append({"op": s["op"], "ok": True})
                if isinstance(got, str) and s["op"] in ("dataset.import", "dataset.clean", "dataset.downsample", "dataset.transform", "export.subset"):
                    known["dataset"] = got
                if "as" in s:
                    known[s["as"]] = got
            except Exception as e:  # noqa: BLE001  what failed is the report's content
                steps.append({"op": s["op"], "ok": False, "error": str(e)[:500]})
                if not s.get("optional"):
                    break
        report.append({"plot": plot, "steps": steps, "ok": all(x["ok"] or s.get("optional") for x, s in zip(steps, recipe["steps"]))})
    return report
