"""Declaring sources, views and outputs in SQL, validating them, and turning each output into one DataFrame.

The slide of every HOP is the window of the output that is evaluated, and every HOP in an output's plan yields exactly the windows whose end lies in the asked range. Views are therefore
templates, expanded per output. Catalyst sees one plan per output, with views inlined and time ranges filtered at the scan.
"""

from __future__ import annotations

import datetime as dt
import itertools
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from eddyline.operators import partitioning
from eddyline.operators.hop import hop, snap
from eddyline.plans import sql as S
from eddyline.schema import Schema

DEFAULT_RECORDS = 1000
_DAY = dt.timedelta(days=1)
_numbers = itertools.count()


@dataclass
class Trigger:
    """When an output is emitted: per window of event time, per number of records, or whichever comes first."""

    window: dt.timedelta | None = None
    records: int | None = None


@dataclass
class Source:
    name: str
    schema: type[Schema] | None = None
    partition_by: list[str] | None = None
    ts_col: str | None = None


@dataclass
class View:
    name: str
    sql: str
    depends_on: list[str]
    partition_by: list[str] | None = None


@dataclass
class Output(View):
    schema: type[Schema] | None = None
    policy: Trigger | None = None
    validate: bool = False

    def trigger(self, window: dt.timedelta | None = None, records: int | None = None) -> Output:
        if records is not None and S.hops(S.tokens(self.sql)):
            raise ValueError("Record triggers cannot be used with HOP-based queries")
        if window is not None:
            if window <= dt.timedelta(0):
                raise ValueError("Window must be positive")
            if window % dt.timedelta(seconds=1) or _DAY % window:
                raise ValueError(f"Window {window} must divide a day evenly")
        self.policy = Trigger(window, records)
        return self


@dataclass
class Node:
    """A source, view or output in the graph, with the trigger that is inferred for it."""

    name: str
    kind: str
    upstream: list[str] = field(default_factory=list)
    downstream: list[str] = field(default_factory=list)
    trigger: Trigger | None = None


class Pipeline:
    """Sources, views and outputs by name."""

    def __init__(self) -> None:
        self.sources: dict[str, Source] = {}
        self.views: dict[str, View] = {}
        self.outputs: dict[str, Output] = {}
        self.functions: dict[str, Any] = {}

    def function(self, name: str, made: Any) -> None:
        """A user-defined function for the SQL of views and outputs, by a name: what pandas_udf gives, per row (Series to Series) or as an aggregate (Series to a value), or udf."""
        self.functions[name] = made

    # partition_by: rows with equal keys are placed together; an empty list means that every partition needs the whole table, which is broadcast if its size is known to be small

    def source(self, name: str, *, schema: type[Schema] | None = None, partition_by: list[str] | None = None, ts_col: str | None = None) -> Source:
        self.sources[name] = Source(name, schema, partition_by, ts_col)
        return self.sources[name]

    def view(self, name: str, sql: str, *, partition_by: list[str] | None = None) -> View:
        self.views[name] = View(name, sql, self._known(sql), partition_by)
        return self.views[name]

    def output(self, name: str, sql: str, *, schema: type[Schema] | None = None, partition_by: list[str] | None = None, validate: bool = False) -> Output:
        """validate: cast the result to the schema and fail at nulls that it does not allow; otherwise the schema is only a declaration."""
        self.outputs[name] = Output(name, sql, self._known(sql), partition_by, schema, None, validate)
        return self.outputs[name]

    def _known(self, sql: str) -> list[str]:
        return sorted(S.extract_tables(sql) & (self.sources.keys() | self.views.keys()))

    # -- planning

    def compile(self) -> dict[str, Node]:
        """Checks the declarations and returns the graph by name."""
        for out in self.outputs.values():
            if out.policy is None or out.policy.window is None and out.policy.records is None:
                raise ValueError(f"All outputs must have a trigger; {out.name} has none")
            for size in S.hop_sizes(out.sql):
                if out.policy.window and size % out.policy.window:
                    raise ValueError(f"HOP size {size} of {out.name} must be a multiple of trigger window {out.policy.window}")
        for view in self.views.values():
            if S.has_group_by(view.sql):
                raise ValueError(f"View {view.name} contains GROUP BY; aggregate in an output")
        for name in self.views:
            self._check_cycle(name, ())
        hopped = {v.name for v in self.views.values() if S.hops(S.tokens(v.sql))}
        for declared in [*self.views.values(), *self.outputs.values()]:
            for h in S.hops(S.tokens(declared.sql)):
                if h.table in hopped and h.ts_col == "window_end":
                    raise ValueError(f"Stacked aggregations not supported: {declared.name} windows {h.table} by window_end")
        for out in self.outputs.values():
            if out.policy.window is None and any(S.hops(S.tokens(self.views[v].sql)) for v in self._upstream_views(out)):
                raise ValueError(f"HOP in a view of {out.name} needs a window trigger")
        nodes = {n: Node(n, "source") for n in self.sources} | {n: Node(n, "view", list(v.depends_on)) for n, v in self.views.items()}
        nodes |= {f"{n}": Node(n, "output", list(o.depends_on), trigger=o.policy) for n, o in self.outputs.items()}
        for node in nodes.values():
            for up in node.upstream:
                nodes[up].downstream.append(node.name)
        for name in [*self.sources, *self.views]:
            windows = [w for o in self.outputs.values() if name in self._all_upstream(o) and (w := o.policy.window)]
            is_hop = name in hopped
            nodes[name].trigger = Trigger(min(windows, default=None), None if is_hop else DEFAULT_RECORDS)
        return nodes

    def _check_cycle(self, name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ValueError(f"View {name} depends on itself")
        for up in self.views[name].depends_on if name in self.views else ():
            self._check_cycle(up, (*path, name))

    def _all_upstream(self, declared: View) -> set[str]:
        found: set[str] = set()
        todo = list(declared.depends_on)
        while todo:
            if (name := todo.pop()) not in found:
                found.add(name)
                todo += self.views[name].depends_on if name in self.views else []
        return found

    def _upstream_views(self, out: Output) -> list[str]:
        return [n for n in self._all_upstream(out) if n in self.views]

    def hops(self, output: str) -> bool:
        """Whether the output or a view of it has a HOP."""
        out = self.outputs[output]
        return any(S.hops(S.tokens(d.sql)) for d in [out, *(self.views[v] for v in self._upstream_views(out))])

    def sources_of(self, output: str) -> list[str]:
        return sorted(n for n in self._all_upstream(self.outputs[output]) if n in self.sources)

    def longest_window(self, output: str) -> dt.timedelta:
        """The longest HOP in the output's plan, at least its trigger window."""
        out = self.outputs[output]
        sizes = [s for d in [out, *(self.views[v] for v in self._upstream_views(out))] for s in S.hop_sizes(d.sql)]
        return max([*sizes, out.policy.window or dt.timedelta(0)])

    def lookback(self, source: str) -> dt.timedelta:
        """How far before the start a source must be read: the longest window downstream of it."""
        return max([self.longest_window(o) for o in self.outputs if source in self._all_upstream(self.outputs[o])], default=dt.timedelta(0))

    # -- evaluation

    def dataframe(self, spark: SparkSession, output: str, tables: dict[str, DataFrame], start: dt.datetime | None = None, end: dt.datetime | None = None, after: dt.datetime | None = None) -> DataFrame:
        """The output over the given source tables. Windows: those ending in [snap(start), snap(end)], or later than after."""
        self.compile()
        for name, made in self.functions.items():
            spark.udf.register(name, made)
        out = self.outputs[output]
        slide = out.policy.window
        first = snap(start, slide) if start is not None and slide else None
        if after is not None and slide:
            first = after + slide
        last = snap(end, slide) if end is not None and slide else None
        found = _Expansion(self, spark, tables, slide, first, last).query(out)
        if out.partition_by:
            found = found.repartition(*out.partition_by)
        return out.schema.conform(found, check_nulls=True) if out.validate and out.schema else found


class _Expansion:
    """One evaluation of an output: names become temporary views of their DataFrames, HOP calls projections."""

    def __init__(self, pipeline: Pipeline, spark: SparkSession, tables: dict[str, DataFrame], slide: dt.timedelta | None, first: dt.datetime | None, last: dt.datetime | None) -> None:
        self.pipeline, self.spark, self.tables, self.slide, self.first, self.last = pipeline, spark, tables, slide, first, last
        self.made: dict[str, DataFrame] = {}

    def relation(self, name: str) -> DataFrame:
        if name not in self.made:
            p = self.pipeline
            if name in p.views:
                df = self.query(p.views[name])
                keys = p.views[name].partition_by
            elif name in p.sources:
                if name not in self.tables:
                    raise ValueError(f"no table for source {name}")
                source = p.sources[name]
                df = source.schema.conform(self.tables[name]) if source.schema else self.tables[name]
                keys = source.partition_by
            else:
                df, keys = self.spark.table(name), None
            if keys is not None and not keys and not df.isStreaming:  # no key at all: every partition needs the whole table
                df = partitioning.broadcast(df)
            self.made[name] = df.repartition(*keys) if keys else df
        return self.made[name]

    def query(self, declared: View) -> DataFrame:
        parts = S.tokens(declared.sql)
        made: list[str] = []

        def bind(df: DataFrame) -> str:
            made.append(f"_eddyline_{next(_numbers)}")
            df.createOrReplaceTempView(made[-1])
            return made[-1]

        try:
            calls = {h.start: h for h in S.hops(parts)}
            named = {r.start: r for r in S.relations(parts)}
            local = S.cte_names(parts)
            out, i = [], 0
            while i < len(parts):
                if i in calls:
                    h = calls[i]
                    if h.size is None:
                        raise ValueError(f"the size of a HOP in {declared.name} is not a literal of days, hours, minutes or seconds")
                    if h.table in local:
                        raise ValueError(f"HOP in {declared.name} takes a source or view, not the common table expression {h.table}")
                    out.append(bind(hop(self.relation(h.table), h.ts_col, h.size, self.slide or h.size, self.first, self.last)))
                    i = h.end + 1
                elif i in named and named[i].name not in local and (named[i].name in declared.depends_on):
                    r = named[i]
                    out += [bind(self.relation(r.name)), *([] if r.aliased else ["AS", r.name])]
                    i = r.end + 1
                else:
                    out.append(parts[i])
                    i += 1
            try:
                return self.spark.sql(S.text(S.to_spark(out)))
            except AnalysisException as e:
                n = S.whole_casts(out)
                if "DATATYPE_MISMATCH" not in str(e) or not n:
                    raise
                numeric: set[int] = set()  # the casts whose operand can be rounded: not those of booleans or times
                for k in range(n):
                    try:
                        self.spark.sql(S.text(S.to_spark(out, (numeric | {k}).__contains__)))
                        numeric.add(k)
                    except AnalysisException:
                        continue
                return self.spark.sql(S.text(S.to_spark(out, numeric.__contains__)))
        finally:
            for name in made:
                self.spark.catalog.dropTempView(name)
