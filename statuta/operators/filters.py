"""Optional search filters as one predicate that the scan can push down."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filters:
    """Lists of allowed values per column; an absent or empty list allows everything."""

    doc_form: tuple = ()
    doc_year: tuple = ()
    doc_number: tuple = ()
    doc_status: tuple = ()
    unit_type: tuple = ()
    pasal_number: tuple = ()
    bab_number: tuple = ()

    def predicate(self) -> Column:
        """All given conditions, joined by AND."""
        given = [F.col(f.name).isin(list(getattr(self, f.name))) for f in fields(self) if getattr(self, f.name)]
        return reduce(lambda a, b: a & b, given, F.lit(True))

    @classmethod
    def from_text(cls, **lists: str | None) -> Filters:
        """Filters from comma-separated texts; years become numbers."""
        def parts(v: str) -> tuple:
            return tuple(x.strip() for x in v.split(",") if x.strip())

        values = {k: parts(v) for k, v in lists.items() if v}
        if "doc_year" in values:
            values["doc_year"] = tuple(int(y) for y in values["doc_year"])
        return cls(**values)
