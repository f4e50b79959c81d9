"""An interpreter of operator lists: each step names an operation, its inputs and its output register."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import filters, graph, hybrid, index, relational, text, vector
from sparkloom.operators.kv import KeyRange


class Program:
    """Runs steps over frames in registers and returns the register of the last step.

    A step is (operation, {argument: value}); ``in`` and ``with`` name registers or tables, ``out`` names
    the result (default: the input's register).  Nothing runs until the result is read, so the
    optimizer sees the whole program as one plan.
    """

    def __init__(self, tables: dict[str, DataFrame]):
        self.registers = dict(tables)

    def run(self, steps: list[tuple[str, dict]]) -> DataFrame:
        last = None
        for op, args in steps:
            handler = getattr(self, f"op_{op.lower()}", None)
            if handler is None:
                raise ValueError(f"no such operation: {op}")
            out = handler(**{("src" if k == "in" else "other" if k == "with" else k): v for k, v in args.items() if k != "out"})
            last = args.get("out", args.get("in", "result"))
            self.registers[last] = out
        return self.registers[last]

    def _get(self, name: str) -> DataFrame:
        return self.registers[name]

    def op_scan(self, src, filter=None):
        df = self._get(src)
        return df.filter(filters.compile_filter(filter)) if filter else df

    def op_scan_node(self, src, label=None):
        return graph.scan_nodes(self._get(src), label)

    def op_scan_edge(self, src, label=None):
        return graph.scan_edges(self._get(src), label)

    def op_expand(self, src, edges, at="id", direction="out", kinds=None, to="neighbor"):
        return graph.expand(self._get(src), self._get(edges), at, direction, kinds, to)

    def op_optional_expand(self, src, edges, at="id", direction="out", kinds=None, to="neighbor"):
        return graph.expand(self._get(src), self._get(edges), at, direction, kinds, to, optional=True)

    def op_match_pattern(self, nodes, edges, pattern, returns=None):
        return graph.match(self._get(nodes), self._get(edges), pattern, returns)

    def op_path_construct(self, src, nodes, edges):
        return graph.construct_paths(self._get(src), nodes, edges)

    def op_filter(self, src, filter=None, sql=None):
        return self._get(src).filter(filters.compile_filter(filter) if filter else F.expr(sql))

    def op_project(self, src, columns):
        return self._get(src).select(*(F.expr(e).alias(n) for n, e in columns.items()))

    def op_aggregate(self, src, keys, aggs):
        return relational.aggregate(self._get(src), keys, aggs)

    def op_sort(self, src, keys):
        return self._get(src).orderBy(*(F.col(k).desc() if d == "desc" else F.col(k).asc() for k, d in keys))

    def op_limit(self, src, count, offset=0):
        df = self._get(src)
        return (df.offset(offset) if offset else df).limit(count)

    def op_distinct(self, src):
        return self._get(src).distinct()

    def op_union(self, src, other, distinct=False):
        return relational.union([self._get(src), self._get(other)], distinct)

    def op_intersect(self, src, other):
        return relational.intersect(self._get(src), self._get(other))

    def op_join(self, src, other, on, how="inner"):
        return self._get(src).join(self._get(other), F.expr(on) if isinstance(on, str) and "=" in on else on, how)

    def op_semi_join(self, src, other, on):
        return self.op_join(src, other, on, "left_semi")

    def op_anti_join(self, src, other, on):
        return self.op_join(src, other, on, "left_anti")

    op_exists = op_semi_join

    def op_apply(self, src, other, on, aggs):
        """For each row of ``in``, aggregates of its matching rows in ``with``: decorrelated by key."""
        grouped = relational.aggregate(self._get(other), list(on), aggs)
        return self._get(src).join(grouped, list(on), "left")

    def op_index_seek(self, src, value):
        return index.exact(self._get(src), value)

    def op_index_range_scan(self, src, lower=None, upper=None, limit=None, reverse=False):
        return index.range_scan(self._get(src), KeyRange(lower, upper, limit=limit, reverse=reverse))

    def op_index_scan(self, src):
        return index.range_scan(self._get(src), KeyRange.all())

    def op_fulltext_search(self, src, query, limit=10, scorer="bm25"):
        return text.search(self._get(src), query, limit, scorer)

    def op_vector_search(self, src, query, k, metric="euclidean"):
        return vector.knn(self._get(src), vector.literal(query), k, metric)

    def op_hybrid_search(self, signals, id, k):
        """signals: (register, score column, weight, lower is better)."""
        return hybrid.combine([(self._get(r), score, weight, lower) for r, score, weight, lower in signals], id, k)

    def op_vector_filter(self, src, filter):
        return self._get(src).filter(filters.compile_filter(filter))

    def op_vector_join(self, src, other, on):
        return self._get(src).join(self._get(other), on)
