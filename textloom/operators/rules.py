"""Rules with priorities and dependencies, planned and applied to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """Extend it or give the two functions: whether the rule applies to a context, and what it does to the rows."""

    id: str
    priority: int = 0
    depends_on: tuple[str, ...] = ()
    applies: Callable[[dict], bool] = lambda ctx: True
    apply: Callable[[DataFrame], DataFrame] = lambda df: df
    predicate: Column | None = None  # rows that the rule concerns


class Context(dict):
    """A map whose keys' case doesn't matter."""

    def __init__(self, values: dict | Iterable = ()):
        super().__init__({str(k).lower(): v for k, v in dict(values).items()})

    def get(self, key, default=None):
        return super().get(str(key).lower(), default)

    def __getitem__(self, key):
        return super().__getitem__(str(key).lower())

    def __setitem__(self, key, value):
        super().__setitem__(str(key).lower(), value)

    def __contains__(self, key):
        return super().__contains__(str(key).lower())


class RuleEngine:
    def __init__(self) -> None:
        self._rules: dict[str, Rule] = {}

    def register(self, rule: Rule) -> RuleEngine:
        """A rule of an id that is known, in any case, replaces the known one in its place."""
        self._rules[rule.id.lower()] = rule
        return self

    def plan(self, ctx: dict | None = None) -> list[Rule]:
        """The rules that apply: by priority, then dependencies, then registration. Unknown dependencies don't count; a cycle is an error."""
        ctx = Context(ctx or {})
        chosen = {k: r for k, r in self._rules.items() if r.applies(ctx)}
        level: dict[str, int] = {}
        waiting = dict(chosen)
        while waiting:
            ready = [k for k, r in waiting.items() if all(d.lower() not in waiting for d in r.depends_on)]
            if not ready:
                raise ValueError(f"rules depend on each other: {sorted(waiting)}")
            for k in ready:
                level[k] = 1 + max((level[d.lower()] for d in waiting[k].depends_on if d.lower() in level), default=-1)
            for k in ready:
                del waiting[k]
        order = {k: i for i, k in enumerate(chosen)}
        return [chosen[k] for k in sorted(chosen, key=lambda k: (-chosen[k].priority, level[k], order[k]))]

    def execute(self, df: DataFrame, ctx: dict | None = None) -> DataFrame:
        """The planned rules one after the other; one with a predicate changes the rows it holds for only."""
        for rule in self.plan(ctx):
            if rule.predicate is None:
                df = df.transform(rule.apply)
            else:
                holds = F.coalesce(rule.predicate, F.lit(False))
                df = df.where(holds).transform(rule.apply).unionByName(df.where(~holds), allowMissingColumns=True)
        return df
