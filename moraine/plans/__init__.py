"""Registered queries over the driver's tables, each with its SQL where SQL can express it."""

from . import extensions, handlers, scalars, sources, streams, tables  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
