"""State of records that change: append-only logs, upserts, sets of links, trails of events. Tables are never updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelwright.operators.windows import latest


def upserted(current: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``current`` with ``changes`` in place of the rows of their keys, and those of new keys added; of several rows of a key the last in ``order`` counts.

    Both have the same columns. Keys collapse in partial aggregates, so a key that changes often is one row per task.
    """
    return latest(current.unionByName(changes), key, order)


def new_links(known: DataFrame, more: DataFrame, link: list[str]) -> DataFrame:
    """The distinct rows of ``more`` (columns ``link``) that ``known`` doesn't have: what a set of links grows by. A null equals a null."""
    return more.select(*link).subtract(known.select(*link))


def trail(events: DataFrame, key: list[str], order: list[str], what: list[str]) -> DataFrame:
    """key, trail: the events of each key as an array of structs (``order``, ``what``), in order. A key's whole trail is one row, as in a document store."""
    return events.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, *what))).alias("trail"))


def unified(parts: dict[str, DataFrame], columns: dict[str, str]) -> DataFrame:
    """One table of several that tell the same in their own ways: origin, and ``columns`` (name and type), null where a part lacks one."""
    out = None
    for origin, part in parts.items():
        made = part.select(F.lit(origin).alias("origin"), *[(F.col(c) if c in part.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
        out = made if out is None else out.unionByName(made)
    return out


def with_evidence(base: DataFrame, key: str, evidence: dict[str, DataFrame]) -> DataFrame:
    """``base`` with a struct column for each table of ``evidence`` (one row for each key), null where it has none, and sources: how many have one."""
    known = []
    for name, table in evidence.items():
        fields = [c for c in table.columns if c != key]
        base = base.join(table.select(key, F.struct(*fields).alias(name)), key, "left")
        known.append(F.col(name).isNotNull().cast("int"))
    return base.withColumn("sources", sum(known[1:], known[0]))


def share(condition: Column) -> Column:
    """Aggregate: the share of rows for which a condition holds, nulls counting as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))
