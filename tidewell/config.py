"""Parameters of a run, checked before anything is read."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChamferConfig:
    """What a run is asked for. ``window`` and ``every``: None takes the defaults for the number of rows of B."""

    data_dir: str
    n_max: int = 1_100_000
    seed: int = 1
    budget: int | None = None
    window: int | None = None
    every: int | None = None
    max_a: int | None = None
    max_b: int | None = None
    rho: float = 1e-4
    both_dynamic: bool = False
    with_importance: bool = False
    hashing_only: bool = False
    grid_only: bool = False
    inject_outlier: bool = False
    no_outlier: bool = False
    exact_cache: str | None = None
    exact_only: bool = False
    k: int | None = None

    def __post_init__(self) -> None:
        wrong = [
            (self.hashing_only and self.grid_only, "hashing_only and grid_only exclude each other"),
            (self.with_importance and not self.hashing_only, "with_importance needs hashing_only"),
            (self.with_importance and self.both_dynamic, "with_importance and both_dynamic exclude each other"),
            (self.inject_outlier and self.no_outlier, "inject_outlier and no_outlier exclude each other"),
            (self.exact_only and self.exact_cache is not None, "exact_only computes what exact_cache would be read for"),
            (self.n_max < 1 or self.rho <= 0, "n_max and rho must be positive"),
            (any(x is not None and x < 1 for x in (self.budget, self.window, self.every, self.max_a, self.max_b, self.k)), "counts must be positive"),
        ]
        for bad, why in wrong:
            if bad:
                raise ValueError(why)

    def windows(self, n_b: int) -> tuple[int, int]:
        """(window, interval) for this many rows of B."""
        window, every = defaults(n_b)
        return self.window or window, self.every or every


def defaults(n_b: int) -> tuple[int, int]:
    """(window, interval) where none are given."""
    return max(1, n_b // 20), max(1, n_b // 56)
