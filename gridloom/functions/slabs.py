"""Closed forms that split an axis of ``n`` cells into ``parts`` slabs.

A rule answers both questions, "which slab owns cell i" and "where does slab p start",
as column arithmetic. Placement therefore needs no join with a threshold table, and
the widths can never disagree with the placement.

=============  ==============================================  =====================
rule           owner of cell i                                 first cell of slab p
=============  ==============================================  =====================
``threshold``  ``((i+1)*P - 1) div n``                         ``(p*n) div P``
``even``       ``(P*i) div n``                                 ``ceil(p*n / P)``
``closed``     ``(P*i) div (n+1)``                             ``ceil(p*(n+1) / P)``
``balanced``   first ``n % P`` slabs one cell wider            ``p*w + min(p, r)``
=============  ==============================================  =====================
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.index import idiv

RULES = ("threshold", "even", "closed", "balanced")


@dataclass(frozen=True)
class Slabs:
    n: int
    parts: int
    rule: str = "balanced"

    def __post_init__(self) -> None:
        if self.rule not in RULES:
            raise ValueError(f"unknown slab rule {self.rule!r}")
        if not 1 <= self.parts <= self.n:
            raise ValueError(f"need 1 <= parts <= cells, got parts={self.parts} cells={self.n}")

    def owner(self, cell: Column) -> Column:
        i, n, parts = cell.cast("bigint"), self.n, self.parts
        if self.rule == "threshold":
            pid = idiv((i + 1) * parts - 1, n)
        elif self.rule == "even":
            pid = idiv(i * parts, n)
        elif self.rule == "closed":
            pid = idiv(i * parts, n + 1)
        else:
            width, wider = divmod(n, parts)
            edge = wider * (width + 1)
            pid = F.when(i < edge, idiv(i, width + 1)).otherwise(idiv(i - edge, width) + wider)
        return pid.cast("int")

    def start(self, slab: Column) -> Column:
        """First cell of a slab; ``start(p + 1)`` is one past its last cell."""
        p, n, parts = slab.cast("bigint"), self.n, self.parts
        if self.rule == "threshold":
            first = idiv(p * n, parts)
        elif self.rule == "even":
            first = idiv(p * n + (parts - 1), parts)
        elif self.rule == "closed":
            first = F.least(idiv(p * (n + 1) + (parts - 1), parts), F.lit(n).cast("bigint"))
        else:
            width, wider = divmod(n, parts)
            first = p * width + F.least(p, F.lit(wider).cast("bigint"))
        return first.cast("int")

    def end(self, slab: Column) -> Column:
        return self.start(slab + 1)

    def widest(self) -> int:
        """Upper bound of a slab's width, known without reading data."""
        cells = self.n + 1 if self.rule == "closed" else self.n
        return -(-cells // self.parts)
