"""Registered queries and the SQL they are held against."""

from . import aggregates, backtest, flows, relational, research, series, streams, vectors  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "latest_child_pending"
