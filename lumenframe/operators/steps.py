"""Named filter steps over DataFrames: checked parameters, further inputs by label, results, notice of start and end."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

#: Stands for a parameter that a caller has to give.
REQUIRED = object()


class StepError(ValueError):
    """A step that can't run with what it was given."""


@dataclass(frozen=True)
class Step:
    """``body(df, parameters, inputs)`` gives a DataFrame, or (DataFrame, results by name).

    ``parameters`` maps names to defaults (``REQUIRED`` where there is none), ``labels`` names the further inputs that the
    body needs; both are checked before it runs, as is ``valid(parameters, inputs)``, which gives a reason or None.
    The body only declares a plan, so nothing is computed until the output is used.
    """

    name: str
    body: Callable[[DataFrame, dict[str, Any], dict[str, DataFrame]], DataFrame | tuple[DataFrame, dict[str, Any]]]
    parameters: Mapping[str, Any] = field(default_factory=dict)
    labels: tuple[str, ...] = ()
    valid: Callable[[dict[str, Any], dict[str, DataFrame]], str | None] | None = None

    def problem(self, parameters: Mapping[str, Any], inputs: Mapping[str, DataFrame]) -> str | None:
        """Why the step can't run, or None."""
        wrong = sorted(set(parameters) - set(self.parameters))
        absent = sorted(k for k, v in self.parameters.items() if v is REQUIRED and k not in parameters)
        unlinked = sorted(set(self.labels) - set(inputs))
        for what, names in (("unknown parameters", wrong), ("parameters without a value", absent), ("inputs not given", unlinked)):
            if names:
                return f"{self.name}: {what}: {', '.join(names)}"
        reason = self.valid(self.settings(parameters), dict(inputs)) if self.valid else None
        return f"{self.name}: {reason}" if reason else None

    def settings(self, parameters: Mapping[str, Any]) -> dict[str, Any]:
        return {**self.parameters, **parameters}

    def run(self, df: DataFrame, parameters: Mapping[str, Any] | None = None, inputs: Mapping[str, DataFrame] | None = None, notify: Callable[[str, str], None] | None = None) -> tuple[DataFrame, dict[str, Any]]:
        """The output and the results; ``notify(step, "started" | "finished" | "failed")`` is called around the body."""
        parameters, inputs, tell = parameters or {}, inputs or {}, notify or (lambda *_: None)
        reason = self.problem(parameters, inputs)
        if reason:
            raise StepError(reason)
        tell(self.name, "started")
        try:
            out = self.body(df, self.settings(parameters), dict(inputs))
        except Exception:
            tell(self.name, "failed")
            raise
        tell(self.name, "finished")
        return out if isinstance(out, tuple) else (out, {})

    def transform(self, inputs: Mapping[str, DataFrame] | None = None, **parameters: Any) -> Callable[[DataFrame], DataFrame]:
        """The step for ``df.transform``."""
        return lambda df: self.run(df, parameters, inputs)[0]
