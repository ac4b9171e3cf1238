"""Static checks of a program against the schemas of its source and target."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from .program import ARRAY_OPS, Origin, Program, Step
from .schema import child


@dataclass(frozen=True)
class PathFault:
    """A path that a schema does not have.  ``kind``: source, target or condition."""

    kind: str
    path: str

    @property
    def failure(self) -> str:
        """The class that scoring gives it, which goes by the words of the
        message: any bad path with ``source`` in its name counts as a source."""
        return "invalid_source_path" if self.kind == "source" or "source" in self.path else "invalid_target_path"


def reads(step: Step) -> Iterator[str]:
    """Every path of the record that a step may read."""
    yield from step.sources
    if step.op == "nest":
        yield from step.options["fields"].values()
    if step.op == "conditional":
        yield step.condition.path
        for branch in (step.options["then"], step.options["otherwise"]):
            if isinstance(branch, Origin) and branch.path is not None:
                yield branch.path


def writes(step: Step) -> Iterator[str]:
    if step.op == "nest":
        for name in step.options["fields"]:
            yield f"{step.to}.{name}"
    else:
        yield step.to


def path_faults(steps: tuple[Step, ...], source: dict[str, Any], target: dict[str, Any]) -> Iterator[PathFault]:
    """Bad paths in program order; of a step reads come before writes, and both
    before what concerns the items of its array."""
    for step in steps:
        for kind, schema, paths in (("source", source, reads(step)), ("target", target, writes(step))):
            for path in paths:
                if child(schema, path) is None:
                    yield PathFault(kind, path)
        if step.op in ARRAY_OPS:
            item, made = ((child(s, p) or {}).get("items", {}) for s, p in ((source, step.source), (target, step.to)))
            if step.op == "map_array":
                yield from path_faults(step.steps, item, made)
            elif child(item, step.condition.path) is None:
                yield PathFault("condition", step.condition.path)


def check(program: Program, source: dict[str, Any], target: dict[str, Any]) -> PathFault | None:
    """The first bad path, or None."""
    return next(path_faults(program.steps, source, target), None)
