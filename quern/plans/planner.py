"""Query operations with costs, and the choice among execution paths, as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..functions.filters import compile_filter
from ..operators import search as S

#: The shares of rows that predicates are taken to keep.
SELECTIVITY = {"equality": 0.1, "filter": 0.2, "range_both": 0.2, "range_one": 0.5, "none": 1.0}


@dataclass
class Cost:
    cpu: float = 0.0
    io: float = 0.0
    memory: float = 0.0
    latency: float = 0.0

    def total(self) -> float:
        return self.cpu + 2 * self.io + 0.5 * self.memory + 3 * self.latency


@dataclass
class Step:
    name: str
    detail: dict[str, Any] = field(default_factory=dict)


@dataclass
class Plan:
    """Steps, their cost, and the DataFrame that they stand for."""

    steps: list[Step]
    cost: Cost
    result: DataFrame

    def explain(self) -> str:
        lines = [f"{i + 1}. {s.name} {s.detail}" for i, s in enumerate(self.steps)]
        return "\n".join([*lines, f"cost {self.cost.total():.3f}"])


def total_cost(cpu: Column, io: Column, memory: Column, latency: Column) -> Column:
    return cpu + 2 * io + 0.5 * memory + 3 * latency


def range_selectivity(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), 0.2).when(low.isNotNull() | high.isNotNull(), 0.5).otherwise(1.0)


def optimal_workers(rows: Column, least: int, most: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.floor(rows / least), F.lit(most))).cast("long")


def vector_search(rows: DataFrame, query: DataFrame, k: int, buckets: DataFrame | None = None, profile: str = "balanced", metric: str = V.COSINE) -> Plan:
    """By probing buckets where there are any, else exact."""
    if buckets is None:
        return Plan([Step("SeqScan"), Step("Sort", {"by": metric}), Step("Limit", {"k": k})], Cost(cpu=1.0, io=1.0), S.topk(rows, query, k, metric))
    share = S.PROBE_SHARE[profile]
    return Plan([Step("AnnSearch", {"profile": profile}), Step("Sort", {"by": metric}), Step("Limit", {"k": k})], Cost(cpu=share, io=share), S.probe_topk(rows, buckets, query, k, profile, metric=metric))


def filtered_search(rows: DataFrame, query: DataFrame, k: int, condition: dict, metadata: str, metric: str = V.COSINE) -> Plan:
    keep = compile_filter(condition, F.col(metadata))
    return Plan([Step("Filter", condition), Step("SeqScan"), Step("Limit", {"k": k})], Cost(cpu=SELECTIVITY["filter"], io=1.0), S.topk(rows, query, k, metric, where=keep))


def range_scan(rows: DataFrame, column: str, low=None, high=None) -> Plan:
    out = rows
    if low is not None:
        out = out.where(F.col(column) >= low)
    if high is not None:
        out = out.where(F.col(column) <= high)
    share = 0.2 if low is not None and high is not None else 0.5 if low is not None or high is not None else 1.0
    return Plan([Step("IndexScan" if share < 1 else "SeqScan", {"column": column, "low": low, "high": high})], Cost(cpu=share, io=share), out)


def aggregate(rows: DataFrame, op: str, column: str) -> Plan:
    """count, sum, avg, min or max of a column where it is not null."""
    made = {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[op](column)
    return Plan([Step("SeqScan"), Step("Filter", {"not null": column}), Step("Aggregate", {op: column})], Cost(cpu=1.0, io=1.0), rows.where(F.col(column).isNotNull()).agg(made.alias("value")))


def full_scan(rows: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> Plan:
    """All rows, or as many as a limit says."""
    out = rows.select(*columns) if columns else rows
    steps = [Step("SeqScan", {"columns": columns or rows.columns})]
    if limit is not None:
        out, steps = out.limit(limit), [*steps, Step("Limit", {"k": limit})]
    return Plan(steps, Cost(cpu=1.0, io=1.0), out)


#: Operations by name. Each takes the rows and its own arguments and gives a plan with the DataFrame that it stands for.
OPERATIONS = {
    "VectorSearch": vector_search,
    "ExactSearch": lambda rows, query, k, metric=V.COSINE: vector_search(rows, query, k, None, metric=metric),
    "FilteredSearch": filtered_search,
    "RangeScan": range_scan,
    "FullScan": full_scan,
    "Aggregate": aggregate,
}


def plan(operation: str, rows: DataFrame, **arguments) -> Plan:
    """The plan of an operation; ValueError for an unknown one."""
    if operation not in OPERATIONS:
        raise ValueError(f"no operation {operation}; there are {', '.join(OPERATIONS)}")
    return OPERATIONS[operation](rows, **arguments)


def path_cost(path: str, prompt_bytes: Column, tokens: int, complexity: float, accept_rate: Column | float, has_view: Column, multiplier: float = 1.0) -> Column:
    """Estimated ms of an execution path."""
    if path == "CachedAnswer":
        return F.lit(0.5 * multiplier)
    exact = F.when(has_view, 0.5).otherwise(prompt_bytes * 0.15) + tokens * 12.0 * complexity
    if path == "SpeculativeDecode":
        rate = accept_rate if isinstance(accept_rate, Column) else F.lit(accept_rate)
        return exact / (1 + 2 * rate) * multiplier
    return exact * (1.15 if path == "SparseDecode" else 1.0) * multiplier


def decide(mode: str, prompt_bytes: Column, has_cache: Column, has_view: Column, accept_rate: Column, sparse_healthy: Column, spec_confidence: Column, sparse_confidence: Column, least_accept: float = 0.6) -> Column:
    """The path taken: policy, then a cached answer, then a restored view, then the cheapest that is trusted."""
    if mode == "exact_only":
        return F.lit("ExactDecode")
    exact, spec, sparse = (path_cost(p, prompt_bytes, 50, 1.0, accept_rate, has_view) for p in ("ExactDecode", "SpeculativeDecode", "SparseDecode"))
    speculative = (accept_rate >= least_accept) & (spec_confidence >= 0.3) & (spec < exact)
    sparse_may = sparse_healthy & F.lit(mode == "sparse") & (sparse_confidence >= 0.2)
    chosen = F.when(speculative & ~(sparse_may & (sparse < spec)), "SpeculativeDecode").when(sparse_may, "SparseDecode").otherwise("ExactDecode")
    return F.when(has_cache, "CachedAnswer").when(has_view, "ExactDecode").otherwise(chosen)


def tier_preference(layer: Column, layers: Column, accesses: Column, last: Column, now: Column) -> Column:
    idle = F.greatest(F.lit(0), now - last)
    return F.when((layer <= 1) | (layer >= F.greatest(F.lit(0), layers - 2)), "Critical").when((last > 0) & (idle >= 3600), "Redundant").when((accesses >= 2) & (idle <= 300), "Critical").otherwise("Important")


#: Words of prompts that want reasoning, and of technical prompts (a parameter of complexity()).
REASONING = ("compare", "why", "explain", "analyze", "difference", "how do i", "what is the relation")
TECHNICAL = ("code", "rust", "compile", "error", "implement", "database")


def route_profile(prompt: Column, exit_layer: Column, average_ms: Column) -> Column:
    deep = T.contains_any(F.lower(prompt), REASONING) | (F.size(T.words(prompt)) > 18) | (exit_layer >= 8)
    return F.when(average_ms > 200.0, "FastPath").when(deep, "DeepPath").otherwise("FastPath")


def complexity(prompt: Column, technical: tuple[str, ...] = TECHNICAL) -> Column:
    score = F.lit(0.5) + F.when(F.size(T.words(prompt)) > 15, 0.2).otherwise(0.0) + F.when(T.contains_any(prompt, technical), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), score))


def op_route(size: Column, op: Column, gpu: bool = True) -> Column:
    if not gpu:
        return F.lit("Cpu")
    return F.when(op.isin("embedding", "sampling"), "Cpu").when((op == "gemv") & (size < 131072), "Cpu").when((op == "gemm") & (size < 262144), "Cpu").otherwise("Gpu")


def backend_fits(layers: Column, hidden: Column, bytes_per: Column, vram: int, binding: int) -> Column:
    return (layers * hidden * hidden * 6 * bytes_per < vram) & (hidden * hidden * bytes_per < binding)


def adapted(value: Column, step: int, low: int, high: int, average_ms: Column, target_ms: float) -> Column:
    """One step of the parameter controller: down where too slow, up where well within the target."""
    return F.when(average_ms <= 0, value).when(average_ms > target_ms, F.when(value > low, F.greatest(value - step, F.lit(low))).otherwise(value)).when(average_ms < target_ms * 0.7, F.when(value < high, F.least(value + step, F.lit(high))).otherwise(value)).otherwise(value)
