"""The registered queries, grouped like the operators they run."""

import importlib

from queryscope.suite.registry import ORACLES, QUERIES

MODULES = ("audits", "correct", "lint", "corpus", "service")


def load():
    for m in MODULES:
        importlib.import_module(f"queryscope.suite.{m}")
    return QUERIES, ORACLES
