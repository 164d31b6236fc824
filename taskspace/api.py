"""The command surface as functions: check, summary, run, help, and their output as text, JSON or YAML."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators import model
from .operators.space import Adaptive


def check(document: str | dict, extensions: Sequence[str] = model.EXTENSIONS) -> dict:
    """Whether a template is valid, and every problem if it isn't."""
    try:
        t = model.decode(document, extensions)
    except model.ModelError as e:
        return {"status": "error", "problems": e.problems}
    return {"status": "success", "kind": t.kind, "problems": []}


def summary(spark: SparkSession, document: str | dict, values: Mapping[str, Any] | None = None, step: str | None = None, environments: Sequence[str | dict] = ()) -> DataFrame:
    """One row for each step of the job that a template makes, or for one of them."""
    job = _job(spark, document, values, environments)
    return model.step_summary(spark, job, step) if step else model.summary(spark, job)[1]


def run(spark: SparkSession, document: str | dict, step: str, values: Mapping[str, Any] | None = None, tasks: list[Mapping] | str | None = None, maximum_tasks: int | None = None, environments: Sequence[str | dict] = ()) -> DataFrame:
    """The command lines of a step's tasks, as far as they are asked for; nothing is executed."""
    job = _job(spark, document, values, environments)
    s = job.step(step)
    if tasks is not None:
        rows = model.task_list(spark, tasks, s.space)
        held = s.space.contains(rows)
        if held.count() != rows.count():
            raise model.ModelError("a task is not in the step's parameter space")
        return model.action_frame(job, step, held)
    if s.space.adaptive:
        plan, found = Adaptive(s.space), []
        while (task := plan.next()) is not None and (maximum_tasks is None or len(found) < maximum_tasks):
            found.append(task)
        return model.action_frame(job, step, spark.createDataFrame(found))
    return model.action_frame(job, step, s.space.tasks(spark, 0, maximum_tasks))


def order(spark: SparkSession, document: str | dict, step: str | None = None, values: Mapping[str, Any] | None = None) -> list[str]:
    """The steps in the order in which they run; with ``step`` only those that it needs, and itself."""
    job = _job(spark, document, values, ())
    every = model.step_order([(s.name, s.depends) for s in job.steps])
    if step is None:
        return every
    need, todo = set(), [job.step(step).name]
    while todo:
        name = todo.pop()
        if name not in need:
            need.add(name)
            todo += job.step(name).depends
    return [n for n in every if n in need]


def parameters(document: str | dict) -> list[dict]:
    """What a template's parameters are, for its help."""
    return model.describe_parameters(model.decode(document))


def _job(spark: SparkSession, document: str | dict, values: Mapping[str, Any] | None, environments: Sequence[str | dict]) -> model.Job:
    return model.create_job(spark, model.decode_job(document), values, [model.decode_environment(e) for e in environments])


def render(result: Any, form: str = "human") -> str:
    """A result as human text, JSON or YAML. Frames are for small tables, such as summaries."""
    rows = [r.asDict(recursive=True) for r in result.collect()] if isinstance(result, DataFrame) else result
    if form == "json":
        return json.dumps(rows, indent=2, default=str)
    if form == "yaml":
        import yaml

        return yaml.safe_dump(rows, sort_keys=False)
    if form != "human":
        raise ValueError(f"unknown output form {form!r}")
    if isinstance(rows, list):
        return "\n".join(", ".join(f"{k}: {v}" for k, v in r.items()) if isinstance(r, Mapping) else str(r) for r in rows)
    return "\n".join(f"{k}: {v}" for k, v in rows.items())
