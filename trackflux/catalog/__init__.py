"""Registered queries and their SQL counterparts, one module per operator family."""

from importlib import import_module

FAMILIES = ["sources", "columns", "joins", "ordered", "windows", "sets", "reports", "model", "evaluation", "streams", "functions"]


def load_all() -> None:
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")
