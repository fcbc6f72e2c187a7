"""Search filters compiled to column predicates."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = {
    "=": lambda c, v: c == v,
    "<>": lambda c, v: c != v,
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
    "IS NULL": lambda c, v: c.isNull(),
    "IS NOT NULL": lambda c, v: c.isNotNull(),
}


@dataclass
class DateFilter:
    operator: str
    value: str | None = None

    def column(self, name: str) -> Column:
        return OPERATORS[self.operator](F.col(name), F.to_timestamp(F.lit(self.value)))


@dataclass
class SearchFilters:
    """Lists are alternatives, empty ones are no condition. Date filters: outer list OR, inner list AND."""

    labels: list[str] = field(default_factory=list)
    edge_types: list[str] = field(default_factory=list)
    group_ids: list[str] = field(default_factory=list)
    created_at: list[list[DateFilter]] = field(default_factory=list)
    valid_at: list[list[DateFilter]] = field(default_factory=list)
    invalid_at: list[list[DateFilter]] = field(default_factory=list)
    expired_at: list[list[DateFilter]] = field(default_factory=list)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def date_condition(name: str, groups: list[list[DateFilter]]) -> Column:
    return reduce(lambda a, b: a | b, [_all([f.column(name) for f in g]) for g in groups]) if groups else F.lit(True)


def node_condition(f: SearchFilters, label: str = "label") -> Column:
    found = [F.col(label).isin(f.labels)] * bool(f.labels) + [F.col("group_id").isin(f.group_ids)] * bool(f.group_ids)
    return _all(found)


def filter_edges(edges: DataFrame, f: SearchFilters, entity: DataFrame | None = None) -> DataFrame:
    """Edges that meet type, group and date conditions, and whose both ends carry one of the labels."""
    found = [F.col("name").isin(f.edge_types)] * bool(f.edge_types) + [F.col("group_id").isin(f.group_ids)] * bool(f.group_ids)
    found += [date_condition(n, getattr(f, n)) for n in ("created_at", "valid_at", "invalid_at", "expired_at")]
    out = edges.filter(_all(found))
    if f.labels:
        ok = entity.filter(node_condition(SearchFilters(labels=f.labels))).select(F.col("uuid").alias("ok"))
        out = out.join(ok, F.col("src") == F.col("ok"), "left_semi").join(ok, F.col("dst") == F.col("ok"), "left_semi")
    return out


def in_time_range(table: DataFrame, start: str, end: str, group_id: str | None = None) -> DataFrame:
    """Rows created within a closed range."""
    hit = F.col("created_at").between(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)))
    if group_id is not None:
        hit = hit & (F.col("group_id") == group_id)
    return table.filter(hit)


def retrieve_episodes(episodic: DataFrame, reference: str, limit: int = 10, group_ids: list[str] | None = None, source: str | None = None) -> DataFrame:
    """The last episodes valid at a reference time, oldest first (``pos`` from 0); a limit below 1 counts as 10."""
    hit = episodic.filter(F.col("valid_at") <= F.to_timestamp(F.lit(reference)))
    if group_ids:
        hit = hit.filter(F.col("group_id").isin(group_ids))
    if source:
        hit = hit.filter(F.col("source") == source)
    from pyspark.sql import Window as W

    last = hit.orderBy(F.col("valid_at").desc(), "uuid").limit(limit if limit > 0 else 10)
    return last.withColumn("pos", F.row_number().over(W.orderBy("valid_at", F.col("uuid").desc())) - 1)


def node_fact() -> Column:
    """A node as one line of text: its summary, else its content, else 'name is a label'."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(some("summary"), some("content"), F.concat("name", F.lit(" is a "), "label"))


def edge_fact() -> Column:
    """An edge as one line of text: its fact, else its name, else its ends."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    return F.coalesce(some("fact"), some("name"), F.concat_ws(" ", "src", F.lit("related to"), "dst"))


def date_range_text(start: Column, end: Column) -> Column:
    """'from - to' of a validity interval."""
    iso = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    return F.concat(F.coalesce(F.date_format(start, iso), F.lit("date unknown")), F.lit(" - "), F.coalesce(F.date_format(end, iso), F.lit("present")))
