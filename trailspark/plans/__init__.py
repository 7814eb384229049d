"""Registered queries over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from trailspark.plans import activity, evidence, views


def queries() -> dict:
    return activity.QUERIES | evidence.QUERIES | views.QUERIES


def oracle_sql() -> dict[str, str]:
    return activity.SQL | evidence.SQL | views.SQL
