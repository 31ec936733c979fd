"""Comoving distance and Cartesian places as column expressions.

A flat universe with cold dark matter, a cosmological constant, photons and neutrinos of which one is
massive; the integral of 1/E is a fixed Gauss-Legendre rule, so it compiles to plain arithmetic.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Published parameters of the 2018 analysis of the cosmic microwave background. Fixed values.
H0 = 67.66
OMEGA_M = 0.30966
T_CMB = 2.7255
N_EFF = 3.046
NEUTRINO_EV = 0.06
#: Speed of light in km/s; radiation density (in units of h^2) at 1 K^4; Boltzmann's constant in eV/K. Fixed values.
C = 299792.458
RADIATION = 2.4728e-5 / 2.7255**4
BOLTZMANN = 8.617333262e-5
#: Fitting constants for massive neutrinos (Komatsu and others, 2011). Fixed values.
FIT_P, FIT_K = 1.83, 0.3173
NODES = 16

_photons = RADIATION * T_CMB**4 / (H0 / 100) ** 2
_t_nu = T_CMB * (4 / 11) ** (1 / 3)
_mass = [NEUTRINO_EV / (BOLTZMANN * _t_nu), 0.0, 0.0]
_per_species = 7 / 8 * (4 / 11) ** (4 / 3) * N_EFF / 3


def _neutrinos(scale):
    """Relative to the photons, at 1 + z = scale."""
    if isinstance(scale, Column):
        massive = F.pow(1 + F.pow(F.lit(FIT_K * _mass[0]) / scale, FIT_P), 1 / FIT_P)
    else:
        massive = (1 + (FIT_K * _mass[0] / scale) ** FIT_P) ** (1 / FIT_P)
    return _per_species * (massive + 2)


_dark = 1 - OMEGA_M - _photons * (1 + float(_neutrinos(1.0)))


def hubble(scale):
    """E at 1 + z = scale."""
    inner = _photons * (1 + _neutrinos(scale)) * scale * scale * scale * scale + OMEGA_M * scale * scale * scale + _dark
    return F.sqrt(inner) if isinstance(scale, Column) else math.sqrt(inner)


def comoving_distance(z: Column, nodes: int = NODES) -> Column:
    """In Mpc."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    total = reduce(lambda a, b: a + b, (F.lit(float(v)) / hubble(1 + z * float((u + 1) / 2)) for u, v in zip(x, w, strict=True)))
    return F.lit(C / H0) * z / 2 * total


def comoving_sql(z: str, nodes: int = NODES) -> str:
    """The same in SQL."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    part = []
    for u, v in zip(x, w, strict=True):
        s = f"(1 + ({z}) * {float((u + 1) / 2)!r}::DOUBLE)"
        nu = f"{_per_species!r}::DOUBLE * (pow(1 + pow({FIT_K * _mass[0]!r}::DOUBLE / {s}, {FIT_P}::DOUBLE), {1 / FIT_P!r}::DOUBLE) + 2)"
        part.append(f"{float(v)!r}::DOUBLE / sqrt({_photons!r}::DOUBLE * (1 + {nu}) * pow({s}, 4) + {OMEGA_M}::DOUBLE * pow({s}, 3) + {_dark!r}::DOUBLE)")
    return f"({C / H0!r}::DOUBLE * ({z}) / 2 * ({' + '.join(part)}))"


def cartesian(ra: Column, dec: Column, distance: Column) -> list[Column]:
    a, d = F.radians(ra), F.radians(dec)
    return [(distance * F.cos(d) * F.cos(a)).alias("xcart"), (distance * F.cos(d) * F.sin(a)).alias("ycart"), (distance * F.sin(d)).alias("zcart")]
