"""Column functions of the operators, by name."""
from rayframe.geometry import to_alu
from rayframe.operators.hardening import curve, evaluate, inverse, monomial, polynomial
from rayframe.operators.phantoms import inside_ellipsoid, inside_turned_ellipsoid
from rayframe.operators.prior import b_tilde, rho, two_b_tilde
from rayframe.operators.scans import finite, normalised, transmission

__all__ = ["b_tilde", "curve", "evaluate", "finite", "inside_ellipsoid", "inside_turned_ellipsoid", "inverse", "monomial", "normalised", "polynomial", "rho", "to_alu", "transmission", "two_b_tilde"]
