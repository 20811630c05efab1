"""Tables in the shared folder, and names for columns that don't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import shared_dir, written

__all__ = ["fresh", "shared_dir", "written"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name starting with ``name`` that no column of ``df`` has (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
