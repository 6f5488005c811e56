"""Registered queries over the driver's tables, with the SQL that says the same."""

from importlib import import_module

MODULES = ("naming", "schemas", "spectra", "features", "splitting", "evaluation", "storing", "training")
FLAGSHIP = "flagship"


def _all(what: str) -> dict:
    return {k: v for m in MODULES for k, v in getattr(import_module(f"adapterlens.plans.{m}"), what).items()}


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict:
    return _all("ORACLES")
