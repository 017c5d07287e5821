"""How much work a query may do, from the number of windows and bytes."""

from __future__ import annotations

from dataclasses import dataclass

TIERS = ("tiny", "medium", "huge")
MIB = 1 << 20


@dataclass(frozen=True)
class QueryPlan:
    tier: str
    window_tier: str
    byte_tier: str
    scan: int
    candidates: int
    rerank: int
    partial: bool
    prefilter: bool


def _limits(tier: str, n: int, k: int) -> tuple[int, int, int]:
    if tier == "tiny":
        return n, max(200, 30 * k), max(120, 20 * k)
    if tier == "medium":
        return min(n, max(1200, 120 * k)), min(max(320, 40 * k), 1200), min(max(200, 25 * k), 320)
    most = min(n, 5000)
    return min(n, max(1500, 90 * k)), most, min(most, 50)


def plan(top_k: int, windows: int, size: int, origins: set[str] = frozenset(), budget: str = "auto") -> QueryPlan:
    """The plan of a query over ``windows`` windows of ``size`` bytes."""
    k = max(1, top_k)
    by_windows = 0 if windows <= 400 else 1 if windows <= 4000 else 2
    by_bytes = 0 if size <= 2 * MIB else 1 if size <= 32 * MIB else 2
    tier = TIERS[max(by_windows, by_bytes)]
    scan, candidates, rerank = _limits(tier, windows, k)
    if "connector" in origins and tier != "tiny":
        scan = max(1, int(scan * 0.9))
    if budget == "thorough":
        candidates, rerank = min(windows, 2 * candidates), int(1.5 * rerank)
        rerank = min(candidates, rerank)
    elif budget == "fast":
        candidates = max(5 * k, candidates // 2)
        rerank = min(candidates, max(3 * k, rerank // 2))
    return QueryPlan(tier, TIERS[by_windows], TIERS[by_bytes], scan, candidates, rerank, windows > scan, tier == "huge")


