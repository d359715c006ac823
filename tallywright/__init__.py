"""Descriptive analytics of business tables, as plans over Spark DataFrames."""

from tallywright import functions, operators, plans, sources
from tallywright.session import build_session

__all__ = ["build_session", "functions", "operators", "plans", "sources"]
