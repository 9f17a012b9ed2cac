"""Named stages in a fixed order, with passes that also report decisions, over a shared state of DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from sparkloom.plans.cache import StageCache

State = dict[str, DataFrame]


@dataclass(frozen=True)
class Stage:
    """Adds the tables in `writes` to the state; `cached` ones are kept under the digest of `inputs` and `config`."""

    name: str
    run: Callable[[State], State]
    writes: tuple[str, ...]
    cached: bool = False
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Pass:
    """Changes tables and gives a `decisions` table (source, subject, state)."""

    name: str
    run: Callable[[State], tuple[State, DataFrame]]
    writes: tuple[str, ...]


def conflicts(steps: list[Stage | Pass]) -> list[str]:
    """Tables that more than one stage writes; passes may rewrite what is there."""
    seen: dict[str, int] = {}
    for s in steps:
        if isinstance(s, Stage):
            for w in s.writes:
                seen[w] = seen.get(w, 0) + 1
    return sorted(w for w, n in seen.items() if n > 1)


def run_stages(steps: list[Stage | Pass], state: State, *, cache: StageCache | None = None, inputs: list[str] | None = None, cancelled: Callable[[], bool] = lambda: False) -> State:
    """Runs the steps in order; `cancelled` is asked between them. Decisions of all passes are in `decisions`."""
    if both := conflicts(steps):
        raise ValueError(f"written twice: {', '.join(both)}")
    state, decisions = dict(state), None
    for s in steps:
        if cancelled():
            raise InterruptedError(s.name)
        if isinstance(s, Pass):
            made, decided = s.run(state)
            decisions = decided if decisions is None else decisions.unionByName(decided)
        elif s.cached and cache is not None:
            made = {w: cache.get(f"{s.name}/{w}", inputs or [], s.config, lambda w=w, s=s: s.run(state)[w]) for w in s.writes}
        else:
            made = s.run(state)
        if set(made) - set(s.writes):
            raise ValueError(f"{s.name} writes what it does not declare")
        state |= made
    if decisions is not None:
        state["decisions"] = decisions
    return state
