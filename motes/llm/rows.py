"""Names of rows that have no key of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_key(doc_id: str, text: str) -> Column:
    """16 bytes that name a row by its id and text; only rows equal in both share them. Null and empty texts differ."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.lit("-"))
    return F.unhex(F.md5(F.concat(name, F.when(F.col(text).isNull(), F.lit(" n")).otherwise(F.concat(F.lit(" t"), F.col(text))))))


def own_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until ``docs`` has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name
