"""Importing this module registers every plan."""

from annolytics.plans import (  # noqa: F401
    agreement_plans,
    job_plans,
    linkage_plans,
    model_plans,
    rollup_plans,
    table_plans,
    text_plans,
    trend_plans,
)
from annolytics.plans.registry import PLANS

__all__ = ["PLANS"]
