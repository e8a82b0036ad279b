"""Registered queries by module; importing the package registers all of them."""

from . import aggregates, islands, joins, observing, quality, scalars, signals, sources, streams  # noqa: F401
from .registry import QUERIES


def queries() -> dict:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in QUERIES.items() if text}
