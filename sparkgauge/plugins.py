"""Registries by kind: preprocessors, finalizers, constraints, aggregates, outputs, trace formats, tokenizers, steps.

Each holds functions of DataFrames (a tokenizer: of Columns; a step: makers of functions (state, row) -> action of a live run),
so what is added runs like what is built in.
"""

from __future__ import annotations

from collections.abc import Callable


class Registry(dict):
    """Functions by name; names are found whatever their case, an unknown one is an error that lists the known ones."""

    def __init__(self, kind: str):
        super().__init__()
        self.kind = kind

    def register(self, *names: str) -> Callable:
        def keep(f: Callable) -> Callable:
            for n in names:
                if n.lower() in self:
                    raise ValueError(f"{self.kind} {n!r} is there already")
                self[n.lower()] = f
            return f

        return keep

    def find(self, name: str) -> Callable:
        if name.lower() not in self:
            raise ValueError(f"no {self.kind} is known as {name!r}; there are {', '.join(sorted(self))}")
        return self[name.lower()]

    def apply(self, name: str, df, **options):
        return self.find(name)(df, **options)


PREPROCESSORS, FINALIZERS, CONSTRAINTS, AGGREGATES = Registry("preprocessor"), Registry("finalizer"), Registry("constraint"), Registry("aggregate")
OUTPUTS, TRACES, TOKENIZERS, STEPS = Registry("output"), Registry("trace format"), Registry("tokenizer"), Registry("step")


def built_in() -> None:
    from .functions import scalars
    from .operators import blocks, constraints, conversations, distribution, export, mapping, preprocess
    from .sources import readers

    for n, f in {"column_mapper": mapping.map_columns, "trim": preprocess.trim, "ignore_short": preprocess.ignore_short, "pad_short": preprocess.pad_short, "prepare": preprocess.prepare, "concatenate": preprocess.concatenate}.items():
        PREPROCESSORS.register(n)(f)
    for n, f in {"generative": mapping.finalise, "conversation_graph": mapping.graph_turns, "linear": conversations.linear_edges}.items():
        FINALIZERS.register(n)(f)
    for n, f in {"error_rate": constraints.error_rate, "first_triggers": constraints.first_triggers, "slope": constraints.slope}.items():
        CONSTRAINTS.register(n)(f)
    for n, f in {"value": distribution.value_summary, "rate": distribution.rate_summary, "concurrency": distribution.concurrency_summary}.items():
        AGGREGATES.register(n)(f)
    for n, f in {"csv": export.write_csv, "json": export.write_json, "files": readers.save}.items():
        OUTPUTS.register(n)(f)
    for n, f in {"lengths": readers.trace, "blocks": blocks.with_blocks, "conversation_blocks": blocks.conversation_blocks}.items():
        TRACES.register(n)(f)
    TOKENIZERS.register("words", "default")(scalars.words)


def stops(when: Callable) -> Callable:
    """A maker of steps that stop once `when(state, **options)` holds."""
    return lambda **options: lambda state, row: "stop" if when(state, **options) else "continue"


def finished(state: dict) -> int:
    return state["completed"] + state["errored"] + state["cancelled"]


for name, when in {
    "max_requests": lambda s, n: finished(s) >= n, "max_errors": lambda s, n: s["errored"] >= n, "max_duration": lambda s, us: s["begin_us"] is not None and s["last_us"] - s["begin_us"] >= us,
    "max_global_error_rate": lambda s, rate, least: finished(s) >= least and s["errored"] >= rate * finished(s),
}.items():
    STEPS.register(name)(stops(when))
built_in()
