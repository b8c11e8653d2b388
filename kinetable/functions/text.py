"""Task texts, prompts, times and token lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as text cleaning knows it.
BLANK = r"\s\p{Z}\x0b\x1c-\x1f\x85"
DEFAULT_TASK = "Perform the task."


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{BLANK}]+|[{BLANK}]+$", "")


def clean_task(text: Column) -> Column:
    """Stripped, with underscores and newlines as spaces."""
    return F.translate(strip(text), "_\n", "  ")


def formalize_task(text: Column, default: str = DEFAULT_TASK) -> Column:
    """Lower case letters, digits and white space only; an empty task takes the default."""
    given = F.when(F.length(text) > 0, text).otherwise(F.lit(default))
    return F.regexp_replace(F.lower(given), rf"[^\p{{L}}\p{{N}}{BLANK}]", "")


def ensure_newline(text: Column) -> Column:
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def build_prompt(task: Column, bins: Column) -> Column:
    """Task and binned state as the text before an action."""
    return F.concat(F.lit("Task: "), clean_task(task), F.lit(", State: "), F.array_join(bins.cast("array<string>"), " "), F.lit(";\nAction: "))


def pack_tokens(tokens: Column, bos: int, prefix: list[int], separator: list[int], vocab: int, skip: int, size: int) -> tuple[Column, Column]:
    """Token ids ``bos, prefix, mirrored tokens, separator`` cut or zero-padded to ``size``, and their mask."""
    def ids(values):
        return F.array(*[F.lit(v).cast("bigint") for v in values])

    mirrored = F.transform(tokens, lambda t: F.lit(vocab - 1 - skip).cast("bigint") - t)
    packed = F.concat(ids([bos, *prefix]), mirrored, ids(separator))
    filled = F.slice(F.concat(packed, F.array_repeat(F.lit(0).cast("bigint"), size)), 1, size)
    return filled, F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: i < F.size(packed))


def parse_mmss(text: Column) -> Column:
    """``MM:SS`` or ``SS`` to whole seconds."""
    parts = F.split(text, ":")
    first = F.get(parts, F.lit(0)).cast("bigint")
    return F.when(F.size(parts) == 2, first * 60 + F.get(parts, F.lit(1)).cast("bigint")).otherwise(first)


def format_mmss(seconds: Column) -> Column:
    """Seconds to ``MM:SS``, cut to whole seconds."""
    whole = F.floor(seconds).cast("bigint")
    minutes, rest = F.floor(whole / 60).cast("string"), (whole % 60).cast("string")
    return F.concat(F.lpad(minutes, F.greatest(F.lit(2), F.length(minutes)), F.lit("0")), F.lit(":"), F.lpad(rest, 2, "0"))


def path_flag(path: Column, part: str) -> Column:
    return F.contains(path, F.lit(part))
