"""Parameters of a sparsification, their presets and the sizes derived from them."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

#: Solver limits: iterations, absolute residual that ends them, relative residual that is accepted.
MAX_ITERATIONS, STOP_RESIDUAL, ACCEPT_RELATIVE = 400, math.sqrt(2) * 1e-7, 0.01


@dataclass(frozen=True)
class Params:
    """epsilon bounds the relative error of quadratic forms; sketch is uniform, discrete or gaussian; reweight is
    sqrt (kept weights are w / sqrt(p)) or inverse (w / p, unbiased); negative_weights is error, abs or drop."""

    epsilon: float = 0.5
    beta_constant: float = 4.0
    row_constant: int = 2
    jl_factor: float = 1.5
    jl_scaling: float = math.sqrt(3.0)
    sketch: str = "uniform"
    sketch_seed: int = 1
    sampling_seed: int = 1
    reweight: str = "sqrt"
    negative_weights: str = "error"
    hash_flavour: str = "xx"
    strategy: str = "auto"

    def __post_init__(self) -> None:
        if not self.epsilon > 0:
            raise ValueError("epsilon must be above 0")
        for value, allowed in ((self.sketch, ("uniform", "discrete", "gaussian")), (self.reweight, ("sqrt", "inverse")), (self.negative_weights, ("error", "abs", "drop"))):
            if value not in allowed:
                raise ValueError(f"{value!r} is none of {allowed}")

    def beta(self, n: int) -> float:
        return self.epsilon**-2 * self.beta_constant * math.log(max(n, 1))

    def threshold(self, n: int) -> int:
        """Edges above which a stream is sparsified again; beta is rounded first."""
        return n * round(self.beta(n)) * self.row_constant

    def jl_dim(self, n: int) -> int:
        """Columns of the sketch."""
        return max(1, math.ceil(math.log2(max(n, 2)) * self.jl_factor))

    def with_(self, **changes) -> Params:
        return replace(self, **changes)


def library_defaults(**changes) -> Params:
    return Params().with_(**changes)


def command_line_defaults(**changes) -> Params:
    return Params(jl_factor=4.0, sketch="discrete", sketch_seed=0, sampling_seed=0).with_(**changes)
