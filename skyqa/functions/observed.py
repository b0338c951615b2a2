"""Counts and warnings that come with the pass that makes the rows, without a job of their own."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation

Counts = Mapping[str, int]


class Watch:
    """Collects what is observed on frames while they are used for the first time.

    :meth:`counts` and :meth:`warnings` wait for that first use (a write, a collect), as there are no counts before it. A frame that is never
    used has none, so ask after the action. A task that runs twice is counted once.
    """

    def __init__(self) -> None:
        self._parts: list[tuple[str, Observation, Callable[[Counts], list[str]]]] = []

    def on(
        self, df: DataFrame, name: str, counts: Mapping[str, Column], warn: Callable[[Counts], list[str]] = lambda found: []
    ) -> DataFrame:
        """``df``, observed: aggregates by name, and the warnings to make of them."""
        observation = Observation(f"{name}-{uuid.uuid4().hex}")
        self._parts.append((name, observation, warn))
        return df.observe(observation, *[c.alias(n) for n, c in counts.items()])

    def counts(self) -> dict[str, dict[str, int]]:
        """What was counted, by the names of the observed frames."""
        return {name: dict(observation.get) for name, observation, _ in self._parts}

    def warnings(self) -> list[str]:
        """The warnings of all observed frames, in their order."""
        return [text for _, observation, warn in self._parts for text in warn(observation.get)]
