"""The queries the driver checks, one module per part of the operator inventory."""

from .base import ORACLES, QUERIES
from . import facts, resolution, reading, intake  # noqa: F401
from .intake import flagship
