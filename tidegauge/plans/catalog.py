"""Imports every plan module once so that its queries register."""

from importlib import import_module

MODULES = ["prices", "evaluation", "themes", "portfolios", "ledgers", "decisions", "corpus", "feeds", "streams"]


def load() -> None:
    for name in MODULES:
        import_module(f"tidegauge.plans.{name}")
