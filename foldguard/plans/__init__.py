"""Queries over the fixture tables, each with the SQL that must give the same rows."""

from . import aggregates, cleaning, features, fitted_space, learning, ordering, screening, selection, splits, versions  # noqa: F401
from .base import REGISTRY  # noqa: F401
