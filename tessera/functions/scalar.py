"""Scalar formulas as columns, so that they stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit conversions and physical constants.
HARTREE_EV = 27.211386245988
BOHR_ANGSTROM = 0.52917721092
ANGSTROM_BOHR = 1.8897261254578281
FLUX_QUANTUM = 2.067833848e-15
BOLTZMANN_EV = 8.617333262145e-5
HBAR = 1.054571817e-34
ELECTRON_MASS = 9.1093837015e-31
ELECTRON_CHARGE = 1.602176634e-19


def wrapped(x: Column) -> Column:
    """x folded into [-0.5, 0.5)."""
    return x - F.floor(x + 0.5)


def centred(i: Column, n: int, step: float) -> Column:
    """Cell number to coordinate, zero at cell n div 2."""
    return (i - n // 2) * F.lit(step)


def window_limit(n: Column, length_nm: Column) -> Column:
    """Half width of the Fourier window of an image of n pixels over length_nm nanometres, in inverse Angstrom."""
    return F.lit(math.pi) * n / (10 * length_nm)


def occupation(energy: Column, mu: Column, kt: Column) -> Column:
    """Fermi-Dirac occupation; a step (strictly below mu) at no temperature. Neither branch can overflow."""
    x = (energy - mu) / kt
    smooth = F.when(x > 0, F.exp(-x) / (1 + F.exp(-x))).otherwise(1 / (1 + F.exp(x)))
    return F.when(kt <= 1e-12, F.when(energy < mu, 1.0).otherwise(0.0)).otherwise(smooth)


def lorentzian(energy: Column, centre: Column, eta: float) -> Column:
    d = energy - centre
    return F.lit(eta / math.pi) / (d * d + eta * eta)


def lorentzian_2d(dk: Column, de: Column, wk: float, we: float) -> Column:
    """Kernel over a wave number and an energy with half widths wk and we; 1 at its centre."""
    return 1 / (1 + (dk / wk) * (dk / wk) + (de / we) * (de / we))


def k_width(length_nm: Column) -> Column:
    """Broadening that a field of view of this length leaves in a wave number."""
    return F.lit(2 * math.pi) / (10 * length_nm)


def e_width(kelvin: Column) -> Column:
    """Full width at half maximum of the thermal kernel; temperatures outside 0.1 to 300 are refused."""
    checked = F.when((kelvin >= 0.1) & (kelvin <= 300.0), kelvin).otherwise(F.raise_error("temperature outside [0.1, 300]"))
    return F.lit(math.log(3 + 2 * math.sqrt(2)) * BOLTZMANN_EV) * checked


def free_electron(k: Column) -> Column:
    """Kinetic energy in eV of a free electron with wave number k in inverse metres."""
    return F.lit(HBAR * HBAR / (2 * ELECTRON_MASS * ELECTRON_CHARGE)) * k * k


def flux_count(field: Column, area: Column) -> Column:
    return field * area / FLUX_QUANTUM


def _complex_root(re: Column, im: Column) -> tuple[Column, Column]:
    """The principal square root."""
    size = F.hypot(re, im)
    return F.sqrt((size + re) / 2), F.when(im < 0, -1.0).otherwise(1.0) * F.sqrt(F.greatest(F.lit(0.0), size - re) / 2)


def complex_quotient(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    size = b[0] * b[0] + b[1] * b[1]
    re, im = complex_product(a, (b[0], -b[1]))
    return re / size, im / size


def junction_conductance(e: Column, delta: Column, z: Column, gamma: Column | float = 0.0) -> Column:
    """Normalised conductance of a normal-superconductor contact at no temperature: gap delta, barrier z, broadening gamma.

    Below the gap 2 A with A = delta^2 / (E^2 + (delta^2 - E^2)(1 + 2 z^2)^2), without broadening. From the gap on, with W = E + i gamma and
    r = sqrt(W^2 - delta^2) / W: Re(1 + ((1 - r^2) / 4 - r^2 z^2 (1 + z^2)) / (1/2 + r (1/2 + z^2))^2)."""
    gamma = F.lit(gamma) if isinstance(gamma, float) else gamma
    d2, e2, z2 = delta * delta, e * e, z * z
    inner = 2 * d2 / (e2 + (d2 - e2) * (1 + 2 * z2) * (1 + 2 * z2))
    root = _complex_root(e2 - gamma * gamma - d2, 2 * e * gamma)
    side = F.when(e < 0, -1.0).otherwise(1.0)
    r = complex_quotient((root[0] * side, root[1] * side), (e, gamma))
    r2 = complex_product(r, r)
    top = ((1 - r2[0]) / 4 - r2[0] * z2 * (1 + z2), -r2[1] / 4 - r2[1] * z2 * (1 + z2))
    g = (F.lit(0.5) + r[0] * (z2 + 0.5), r[1] * (z2 + 0.5))
    return F.when(F.abs(e) < delta, inner).otherwise(1 + complex_quotient(top, complex_product(g, g))[0])


def grid_dimension(text: Column, which: int) -> Column:
    """The first (1) or second (2) number of `10 x 20`; 0 if the text has another form."""
    part = F.regexp_extract(F.replace(text, F.lit(" "), F.lit("")), r"^(\d+)x(\d+)$", which)
    return F.coalesce(part.try_cast("int"), F.lit(0))


def complex_product(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]
