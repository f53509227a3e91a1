"""All registered queries of the library and their SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("..operators.spatial", "..operators.fleet", "..operators.cards", "..operators.rollups", "..operators.web", "..operators.rentals", "..operators.rides", "..operators.settle", "..operators.routes", "..operators.community", "..operators.people", ".stored")

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = import_module(_name, __package__)
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
