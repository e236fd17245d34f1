"""Conditions on a request, listed in the order of their contract; the first that fails is the error."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from tabulon.errors import EngineError

Condition = tuple[bool | Callable[[], bool], str]


def require(conditions: Iterable[Condition]) -> None:
    """Raise the message of the first condition that does not hold; those given as functions are only asked then."""
    for holds, message in conditions:
        if not (holds() if callable(holds) else holds):
            raise EngineError(message)


def known(kind: str, value: str, among: Sequence[str]) -> Condition:
    return value in among, f"{kind} '{value}' is not one of {', '.join(among)}."


def predictors(dependent: str, independent: Sequence[str], *, optional: bool = False) -> list[Condition]:
    """At least one predictor, and the response not among them."""
    return [
        (optional or bool(independent), "No predictor was given."),
        (dependent not in independent, f"The response '{dependent}' is listed as a predictor too."),
    ]


def enough(observations: int, least: int) -> Condition:
    return observations >= least, f"{observations} complete rows are too few; this needs {least}."


def varying(prepared, columns: Iterable[str], role: str = "Predictor") -> list[Condition]:
    return [(not prepared.constant(c), f"{role} '{c}' has one value only.") for c in columns]
