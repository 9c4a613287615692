"""Timed vine fits."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame

from ..functions.families import SETS
from ..operators.controls import FitControlsVinecop
from ..operators.vinecop import Vinecop


def benchmark(u: DataFrame, columns: list[str]) -> list[float]:
    """Seconds of three vine fits: families with tau inversion by likelihood, the same by inversion, local likelihood."""
    itau = list(SETS["itau"])
    out = []
    for controls in (FitControlsVinecop(family_set=itau), FitControlsVinecop(family_set=itau, parametric_method="itau"), FitControlsVinecop(family_set=["tll"])):
        start = time.time()
        Vinecop.from_data(u, columns, controls=controls)
        out.append(time.time() - start)
    return out
