"""Grid and scan geometry that travel next to a DataFrame as plain numbers."""

from __future__ import annotations

import math
from dataclasses import dataclass


@dataclass(frozen=True)
class GridDims:
    """Extent of a 3-D grid stored x fastest, then y, then z."""

    nx: int
    ny: int
    nz: int

    @property
    def plane(self) -> int:
        return self.nx * self.ny

    @property
    def cells(self) -> int:
        return self.plane * self.nz

    def along(self, axis: str) -> int:
        return {"x": self.nx, "y": self.ny, "z": self.nz}[axis]


@dataclass(frozen=True)
class TiltGeometry:
    """Parallel-beam geometry: ``n_proj`` tilts of ``n_ray`` rays over an ``n_side`` square."""

    n_side: int
    n_proj: int
    n_ray: int
    pixel_width: float = 1.0
    ray_width: float = 1.0

    @property
    def rays(self) -> int:
        return self.n_proj * self.n_ray

    @property
    def pixels(self) -> int:
        return self.n_side * self.n_side

    @property
    def half(self) -> float:
        return self.n_side * self.pixel_width / 2.0

    def angle(self, proj: int) -> int:
        """Tilt in degrees; steps of two, symmetric about zero."""
        return 2 * proj - (self.n_proj - 1)

    def matrix_rows_bound(self) -> int:
        """A ray crosses at most 2N+1 cells, so this bounds the ray/pixel table."""
        return self.rays * (2 * self.n_side + 1)


def fourth_root(n: int) -> int:
    return math.isqrt(math.isqrt(n))
