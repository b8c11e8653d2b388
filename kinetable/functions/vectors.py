"""Vector columns: packing, slicing, padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinetable.functions.names import named


def pack_vector(names: Sequence[str], kind: str = "float") -> Column:
    """Named scalar columns to one vector, in the order of the names."""
    return F.array(*[named(n) for n in names]).cast(f"array<{kind}>")


def unpack_vector(vector: Column, names: Sequence[str]) -> list[Column]:
    return [F.get(vector, F.lit(i)).alias(n) for i, n in enumerate(names)]


def parse_ranges(text: str) -> list[tuple[int, int]]:
    """``"0:6,7:23"`` to half-open ranges; an empty text keeps everything."""
    out = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        start, _, end = part.partition(":")
        out.append((int(start), int(end)))
    return out


def slice_dims(vector: Column, ranges: str) -> Column:
    """Keep the dimensions of the given ranges, in their order."""
    parts = [F.slice(vector, a + 1, b - a) for a, b in parse_ranges(ranges)]
    return F.concat(*parts) if parts else vector


def pad_vector(vector: Column, size: int) -> Column:
    """Zeros up to ``size``; a longer vector is unchanged."""
    missing = F.greatest(F.lit(size) - F.size(vector), F.lit(0))
    return F.concat(vector, F.array_repeat(F.lit(0.0), missing))


def pad_or_trim(vector: Column, size: int) -> Column:
    return F.slice(pad_vector(vector, size), 1, size)


def validity_mask(vector: Column, size: int) -> Column:
    """True for the places of ``pad_or_trim`` that hold data."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < F.size(vector))


def fit_horizon(chunk: Column, steps: int) -> Column:
    """A chunk cut to ``steps``, or filled up by repeating its last step."""
    missing = F.greatest(F.lit(steps) - F.size(chunk), F.lit(0))
    return F.slice(F.concat(chunk, F.array_repeat(F.element_at(chunk, -1), missing)), 1, steps)
