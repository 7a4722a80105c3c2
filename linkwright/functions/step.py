"""Steps: named Column-to-Column functions that a strategy chains per column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["Step", "custom_step", "run_steps"]


@dataclass(frozen=True)
class Step:
    """One step of a pipeline.

    ``takes`` and ``gives`` are "text" or "tokens"; "any" works on either (an encoder, which
    maps over the elements of a token list). Called with a Column, a step is a plain function.
    """

    name: str
    fn: Callable[[Column], Column] = field(repr=False, compare=False)
    takes: str = "text"
    gives: str = "text"
    args: tuple = ()

    def __call__(self, column: Column | str, tokens: bool | None = None) -> Column:
        c = F.col(column) if isinstance(column, str) else column
        if self.takes == "any":
            return F.transform(c, self.fn) if tokens else self.fn(c)
        return self.fn(c)

    def describe(self) -> str:
        return f"{self.name}({', '.join(f'{k}={v!r}' for k, v in self.args)})"


def custom_step(fn: Callable[[Column], Column], name: str = "custom", takes: str = "text", gives: str = "text") -> Step:
    """A step of the user's own: any function from Column to Column (a pandas UDF too)."""
    return Step(name, fn, takes, gives)


def run_steps(column: Column, steps: tuple[Step, ...] | list[Step]) -> Column:
    """The pipeline's token list. A pipeline that ends in text gives that text as one token, null for none."""
    c, tokens = column, False
    for s in steps:
        if s.takes == "tokens" and not tokens:
            raise ValueError(f"{s.name} needs tokens; put a tokeniser before it")
        if s.takes == "text" and tokens:
            raise ValueError(f"{s.name} needs text, but the step before it gives tokens")
        c = s(c, tokens)
        tokens = tokens or s.gives == "tokens"
    return c if tokens else F.when(c.isNotNull(), F.array(c))
