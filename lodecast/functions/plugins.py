"""Named functions that a user may replace: token counts, embedders of texts, scorers of answers."""

from __future__ import annotations

from collections.abc import Callable

TOKENS, EMBEDDERS, SCORERS = "tokens", "embedder", "scorer"
_NAMED: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, function: Callable) -> None:
    """Makes function known as name; a later one of the same name replaces it.

    kind `tokens`: text column to count column; `embedder`: list of texts to a float array of one row each;
    `scorer`: response and target columns to a boolean column.
    """
    if kind not in (TOKENS, EMBEDDERS, SCORERS):
        raise ValueError(f"unknown kind {kind!r}")
    _NAMED[kind, name] = function


def named(kind: str, name: str) -> Callable:
    if (kind, name) not in _NAMED:
        have = sorted(n for k, n in _NAMED if k == kind)
        raise KeyError(f"no {kind} named {name!r}; known: {', '.join(have)}")
    return _NAMED[kind, name]
