"""Imports every query module so that the registry is complete."""

from . import (  # noqa: F401
    comparison,
    inference,
    modelling,
    operating_points,
    performance,
    preparation,
    reporting,
)
from .registry import QUERIES, SQL  # noqa: F401
