"""What a pipeline is: named steps in dependency order, with checks, contracts and parameters."""

from __future__ import annotations

import functools
import hashlib
import inspect
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame

from ..sources.versions import NAME_PATTERN

Frames = dict[str, DataFrame]
Build = Callable[[Frames], DataFrame]


def _text_of(build: Build, uses: tuple = ()) -> str:
    """The source of a function, the arguments bound to it, and what it declares to use."""
    bound = {}
    if isinstance(build, functools.partial):
        if build.args:
            raise ValueError("Bind arguments of a step by name, so that they are part of its text")
        bound, build = build.keywords, build.func
    text = _source(build) + "".join(f"\n# {k} = {v!r}" for k, v in sorted(bound.items()))
    return text + "".join(f"\n# uses {_text_of(u) if callable(u) else repr(u)}" for u in uses)


def _source(build: Build) -> str:
    try:
        return inspect.getsource(build)
    except (OSError, TypeError):
        return f"{build.__module__}.{build.__qualname__}"


@dataclass(frozen=True)
class Check:
    """A query for violating rows. ``uses`` names the helpers and constants of a function, which are
    then part of the definition. ``table`` with ``where`` or ``keys`` lets it be counted
    together with others over the same table; ``same_rows_as`` needs no query at all."""

    name: str
    sql: str | None = None
    build: Build | None = None
    severity: str = "blocking"
    description: str = ""
    table: str | None = None
    where: str | None = None
    keys: tuple[str, ...] = ()
    copies: str = "<> 1"
    same_rows_as: str | None = None
    uses: tuple = ()

    def __post_init__(self):
        if self.severity not in ("blocking", "warning"):
            raise ValueError(f"Unknown severity: {self.severity!r}")
        if (self.sql is None) == (self.build is None):
            raise ValueError("A check is either SQL or a function")

    @property
    def text(self) -> str:
        return self.sql if self.sql is not None else _text_of(self.build, self.uses)


def row_check(name: str, table: str, where: str, **options) -> Check:
    """Rows of one table for which a condition holds."""
    return Check(name, f"SELECT * FROM {table} WHERE {where}", table=table, where=where, **options)


def key_check(name: str, table: str, keys: list[str], copies: str = "<> 1", **options) -> Check:
    """Keys of one table whose number of copies is wrong."""
    columns = ", ".join(keys)
    sql = f"SELECT {columns}, count(*) AS copies FROM {table} GROUP BY {columns} HAVING count(*) {copies}"
    return Check(name, sql, table=table, keys=tuple(keys), copies=copies, **options)


def grain_check(name: str, table: str, source: str, **options) -> Check:
    """The step must have as many rows as one of its inputs."""
    sql = (
        f"SELECT * FROM (SELECT (SELECT count(*) FROM {table}) AS actual, "
        f"(SELECT count(*) FROM {source}) AS expected) WHERE actual <> expected"
    )
    return Check(name, sql, table=table, same_rows_as=source, **options)


@dataclass(frozen=True)
class Step:
    """One SELECT, or one function of the declared inputs.

    ``uses`` names the helpers and constants that the function depends on, so that a change of
    them is a change of the definition.
    """

    name: str
    title: str
    depends_on: tuple[str, ...]
    sql: str | None = None
    build: Build | None = None
    checks: tuple[Check, ...] = ()
    uses: tuple = ()

    def __post_init__(self):
        names = [c.name for c in self.checks]
        if len(set(names)) < len(names):
            raise ValueError(f"Checks of step {self.name!r} must have names of their own")
        if not re.fullmatch(NAME_PATTERN, self.name):
            raise ValueError(f"Not a step name: {self.name!r}")
        if (self.sql is None) == (self.build is None):
            raise ValueError("A step is either SQL or a function")

    @property
    def text(self) -> str:
        return self.sql if self.sql is not None else _text_of(self.build, self.uses)

    def as_json(self) -> str:
        checks = [[c.name, c.severity, c.description, c.text] for c in self.checks]
        return json.dumps([self.title, list(self.depends_on), self.text, checks], ensure_ascii=False)


@dataclass(frozen=True)
class Pipeline:
    """Steps over sources. ``sources`` maps each input to its contract ``{column: type}``."""

    name: str
    title: str
    sources: dict[str, dict[str, str]]
    steps: tuple[Step, ...]
    output: str
    assumptions: tuple[str, ...] = ()
    description: str = ""
    parameters: dict[str, object] = field(default_factory=dict)
    finding: tuple[str, str, str] | None = None  # label, metric and unit column of the output

    def __post_init__(self):
        known = set(self.sources)
        for name in known:
            if not re.fullmatch(NAME_PATTERN, name):
                raise ValueError(f"Not a source name: {name!r}")
        for step in self.steps:
            unknown = set(step.depends_on) - known
            if unknown:
                raise ValueError(f"Step {step.name} is listed before its inputs {sorted(unknown)}")
            if step.name in known:
                raise ValueError(f"Two tables are called {step.name}")
            known.add(step.name)
        if self.output not in {s.name for s in self.steps}:
            raise ValueError(f"The output {self.output!r} is not a step")

    def rows(self) -> list[tuple[str, str, int, str]]:
        """The definition as rows ``(kind, name, position, value)``."""
        rows = [("title", "", 0, self.title), ("description", "", 0, self.description)]
        rows += [("output", "", 0, self.output)]
        rows += [("assumption", str(i), i, a) for i, a in enumerate(self.assumptions)]
        rows += [
            ("source", name, i, json.dumps(columns, sort_keys=True))
            for i, (name, columns) in enumerate(self.sources.items())
        ]
        rows += [("parameter", n, 0, json.dumps(v)) for n, v in self.parameters.items()]
        rows += [("step", s.name, i, s.as_json()) for i, s in enumerate(self.steps)]
        return rows

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(self.rows()).encode()).hexdigest()

    def revise(self, *steps: Step, **changes) -> Pipeline:
        """A changed copy: the given steps replace those of the same name."""
        new = {s.name: s for s in steps}
        unknown = set(new) - {s.name for s in self.steps}
        if unknown:
            raise ValueError(f"No such steps: {sorted(unknown)}")
        kept = tuple(new.get(s.name, s) for s in self.steps)
        return replace(self, **({"steps": kept} | changes))
