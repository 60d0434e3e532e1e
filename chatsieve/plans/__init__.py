"""Registered queries over the shared test tables, each with its SQL oracle."""

from __future__ import annotations

import importlib

from chatsieve.plans.common import REGISTRY

_MODULES = [
    "chatsieve.plans.scoring",
    "chatsieve.plans.cleaning",
    "chatsieve.plans.building",
    "chatsieve.plans.pairs",
    "chatsieve.plans.sequences",
    "chatsieve.plans.measures",
    "chatsieve.plans.logs",
    "chatsieve.plans.files",
]


def registry():
    for m in _MODULES:
        importlib.import_module(m)
    return REGISTRY
