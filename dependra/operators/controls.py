"""Fit controls of pair and vine copulas."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.families import NAMES
from .dependence import CRITERIA

UNTRUNCATED = (1 << 64) - 1


@dataclass
class FitControlsBicop:
    """How a pair copula is fitted and selected.

    ``weights`` names a column of the data.  ``num_threads`` is accepted for
    compatibility; Spark decides about parallelism.
    """

    family_set: list[str] = field(default_factory=lambda: list(NAMES))
    parametric_method: str = "mle"
    nonparametric_method: str = "constant"
    nonparametric_mult: float = 1.0
    selection_criterion: str = "bic"
    weights: str | None = None
    psi0: float = 0.9
    preselect_families: bool = True
    allow_rotations: bool = True
    num_threads: int = 1

    def __post_init__(self) -> None:
        self.family_set = list(self.family_set) or list(NAMES)

    def __setattr__(self, name: str, value: object) -> None:
        allowed = {
            "parametric_method": ("mle", "itau"),
            "nonparametric_method": ("constant", "linear", "quadratic"),
            "selection_criterion": ("loglik", "aic", "bic", "mbic", "mbicv"),
            "tree_criterion": CRITERIA,
            "tree_algorithm": ("mst_prim", "mst_kruskal", "random_weighted", "random_unweighted"),
        }
        if name in allowed and value not in allowed[name]:
            raise ValueError(f"{name} must be one of {allowed[name]}")
        if name == "psi0" and not 0 < float(value) < 1:
            raise ValueError("psi0 must be in (0, 1)")
        if name == "nonparametric_mult" and not float(value) > 0:
            raise ValueError("nonparametric_mult must be positive")
        if name == "threshold" and not 0 <= float(value) <= 1:
            raise ValueError("threshold must be in [0, 1]")
        if name == "family_set" and (unknown := set(value) - set(NAMES)):
            raise ValueError(f"unknown families: {sorted(unknown)}")
        object.__setattr__(self, name, value)

    def __str__(self) -> str:
        return "\n".join(f"{k}: {v}" for k, v in self.__dict__.items())


@dataclass
class FitControlsVinecop(FitControlsBicop):
    """How a vine copula is fitted and selected."""

    trunc_lvl: int = UNTRUNCATED
    tree_criterion: str = "tau"
    threshold: float = 0.0
    select_trunc_lvl: bool = False
    select_threshold: bool = False
    select_families: bool = True
    show_trace: bool = False
    tree_algorithm: str = "mst_prim"
    seeds: list[int] = field(default_factory=list)

    def bicop(self) -> FitControlsBicop:
        """The controls of the pair copulas."""
        return FitControlsBicop(**{k: getattr(self, k) for k in FitControlsBicop.__dataclass_fields__})
