"""Edits to texts as an expression: literal replacements in sequence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def apply_edits(text: Column, edits: Column) -> Column:
    """Apply an array of ``struct<old, new, every>`` in order: each replaces the first or every occurrence of ``old``.

    An edit whose ``old`` is empty or absent leaves the text as it is.
    """

    def one(t: Column, e: Column) -> Column:
        at = F.call_function("instr", t, e["old"])
        first = F.concat(F.substring(t, F.lit(1), at - 1), e["new"], F.substring(t, at + F.length(e["old"]), F.length(t)))
        changed = F.when(e["every"], F.replace(t, e["old"], e["new"])).otherwise(first)
        return F.when((e["old"] == "") | (at == 0), t).otherwise(changed)

    return F.aggregate(edits, text, one)
