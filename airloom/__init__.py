"""airloom: hourly sensor, forecast and alert analytics as Spark DataFrame operators."""

from airloom.session import build_session

__all__ = ["build_session"]
