"""Shared pieces of the training-data operators: column names that can't clash, and text handling
inside Arrow batches. Tables that cut lineage are those of ``gleaner.storage``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.storage import shared_dir, small_batches, written

__all__ = ["PIECE_CHARS", "WORD", "col", "fresh", "hold", "pieces", "shared_dir", "small_batches", "words", "written"]

WORD = re.compile(r"[^\W_]+")
#: Longer texts are tokenised in pieces of about this many characters, so that the tokens of
#: one text never stand in memory at once. Every piece is used.
PIECE_CHARS = 1 << 20


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, in any letter case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"gl_{name}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


class _Cache(Protocol):
    def clear(self) -> None: ...


_held: list[_Cache] = []


def hold(cache: _Cache | None) -> None:
    """Called by a task whose operator keeps words in ``cache`` from task to task, or needs room itself. Spark hands a worker from operator to
    operator, so the words of the one before go: the worker never holds those of several. Caches fill again, so results don't depend on it."""
    for other in _held:
        if other is not cache:
            other.clear()
    _held[:] = [] if cache is None else [cache]


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """The text in slices that end before white space where there is any; joined they are the text."""
    start = 0
    while len(text) - start > size:
        end = start + size
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())
