"""Imports every module that registers queries."""
import importlib

NAMES = ["language", "catalogue", "similar", "claims", "sequences", "edits", "spotting", "ranking", "flows"]


def load():
    for n in NAMES:
        importlib.import_module(f"shotweave.registry.{n}")
