"""Registered queries: operators bound to the given tables."""

from __future__ import annotations

from importlib import import_module

from assayer.plans.registry import PLANS, TWINS, Plan

MODULES = (
    "text_plans",
    "retrieval_plans",
    "dataset_plans",
    "scoring_plans",
    "policy_plans",
    "statistics_plans",
    "workflow_plans",
)


def all_plans() -> tuple[dict[str, Plan], dict[str, str]]:
    for module in MODULES:
        import_module(f"assayer.plans.{module}")
    return dict(PLANS), dict(TWINS)
