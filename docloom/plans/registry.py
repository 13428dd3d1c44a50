"""Replaceable table stages by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]


class Stages:
    """Named stages that map one table to the next."""

    def __init__(self, **stages: Stage):
        self._stages: dict[str, Stage] = dict(stages)

    def register(self, step: str, stage: Stage) -> None:
        """Add a stage or replace the one of that name."""
        self._stages[step] = stage

    def run(self, df: DataFrame, steps: list[str]) -> DataFrame:
        """The lazy composition of the named stages."""
        for step in steps:
            df = df.transform(self._stages[step])
        return df
