"""Queries over the given tables, each with its SQL twin where SQL can say it."""

from catalog import events, geometry, greedy, html, joins, readers, reports, scoring, text, urls, windows  # noqa: F401
from catalog.registry import ORACLE, QUERIES  # noqa: F401
