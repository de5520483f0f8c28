"""Queries that bind the operators to the supplied tables."""

from importlib import import_module

_MODULES = (
    "fewshot",
    "agreement",
    "catalog",
    "grading",
    "answers",
    "conditions",
)


def load_all() -> None:
    for module in _MODULES:
        import_module(f"specgrade.plans.{module}")
