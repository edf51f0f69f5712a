"""Names of queries. A query is a function of a Store; its SQL goes on from the model's views, with more views after a '+'."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Entry:
    function: Callable
    sql: str | None


REGISTERED: dict[str, Entry] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(function: Callable) -> Callable:
        REGISTERED[name] = Entry(function, sql)
        return function

    return register
