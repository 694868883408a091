"""Options of builds and searches, and grids of them."""

from __future__ import annotations

import itertools
from dataclasses import dataclass


@dataclass(frozen=True)
class BuildOptions:
    """How a graph is built; the checks are those of its builder."""

    degree: int | tuple[int, ...] = 16
    beam: int = 100
    overflow: float = 1.2
    alpha: float = 1.2
    hierarchy: bool = True
    refine: bool = True

    def __post_init__(self) -> None:
        degrees = self.degree if isinstance(self.degree, tuple) else (self.degree,)
        if not degrees or min(degrees) < 1:
            raise ValueError("degree must be positive")
        if len(degrees) > 1 and not self.hierarchy:
            raise ValueError("degrees by layer need the hierarchy")
        if self.beam < 1:
            raise ValueError("beam must be positive")
        if self.overflow < 1:
            raise ValueError("overflow must be at least 1")
        if self.alpha <= 0:
            raise ValueError("alpha must be positive")
        object.__setattr__(self, "_degrees", degrees)
        object.__setattr__(self, "degree", degrees[0])

    def layer_degree(self, level: int) -> int:
        return self._degrees[min(level, len(self._degrees) - 1)]


@dataclass(frozen=True)
class Compression:
    """Which codec a run uses: none, product (m parts, or a part for each ``m_factor`` dimensions) or binary."""

    kind: str = "none"
    m: int | None = None
    m_factor: int | None = None
    k: int = 256
    center: bool | None = None
    threshold: float = -1.0

    def parts(self, dim: int) -> int:
        if self.kind != "product":
            raise ValueError(f"{self.kind} has no parts")
        if self.m is None and self.m_factor is None:
            raise ValueError("give m or m_factor")
        return self.m if self.m is not None else max(1, dim // self.m_factor)

    def centered(self, metric: str) -> bool:
        """Centring moves dot products and angles, so it is for distances unless asked for."""
        return metric == "l2" if self.center is None else self.center


def grid(**choices) -> list[dict]:
    """All combinations of lists of choices, in order; a single value is a list of one."""
    lists = {k: v if isinstance(v, (list, tuple)) else [v] for k, v in choices.items()}
    return [dict(zip(lists, values)) for values in itertools.product(*lists.values())]


def rerank_k(k: int, overquery: float) -> int:
    return int(k * overquery)
