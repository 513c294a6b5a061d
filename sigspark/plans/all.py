"""Every registered query."""

from . import bundled, coupled, kernels, signal, spectrum, tables  # noqa: F401
from . import composed_sql, decomposed, directed, extended, filtered, fitted, measures  # noqa: F401, E402, I001  (after the parts)
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
