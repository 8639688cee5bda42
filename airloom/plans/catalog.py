"""Imports every plan module, which registers its queries."""

from airloom.plans import alerts, evaluation, quality, snapshots, streams, tables, timeline, training  # noqa: F401
from airloom.plans.registry import PLAIN, QUERIES, SQL  # noqa: F401
