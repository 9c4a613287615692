"""dependra: dependence modelling (copulas and vines) and corpus work on Spark DataFrames.

Names are loaded when they are first used, so that workers import only what
their tasks need.
"""

from __future__ import annotations

import importlib

__version__ = "0.1.0"

_WHERE = {
    "Bicop": "operators.bicop",
    "Vinecop": "operators.vinecop",
    "FitControlsBicop": "operators.controls",
    "FitControlsVinecop": "operators.controls",
    "RVineStructure": "operators.structure",
    "CVineStructure": "operators.structure",
    "DVineStructure": "operators.structure",
    "simulate_uniform": "functions.qrng",
    "simulate_normal": "functions.qrng",
    "sobol": "functions.qrng",
    "ghalton": "functions.qrng",
    "pseudo_obs": "operators.pobs",
    "density_grid": "operators.grids",
    "dependence_matrix": "operators.dependence",
    "benchmark": "plans.benchmark",
}
_ALIAS = {"to_pseudo_obs": "pseudo_obs"}

__all__ = ["__version__", "families", *_WHERE, *_ALIAS]  # noqa: PLE0604


def __getattr__(name: str) -> object:
    """A class or function of the library, a family's name, or a family set."""
    name = _ALIAS.get(name, name)
    if name in _WHERE:
        return getattr(importlib.import_module(f"{__name__}.{_WHERE[name]}"), name)
    if name.startswith("_"):
        raise AttributeError(name)
    registry = importlib.import_module(f"{__name__}.functions.families")
    if name == "families":
        return registry.SETS
    if name in registry.NAMES:
        return name
    if name in registry.SETS:
        return list(registry.SETS[name])
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
