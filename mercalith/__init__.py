"""Merchant master-data preparation and compliance checks as Spark DataFrame plans."""

from mercalith.plans.checker import Violations, check
from mercalith.plans.master import build_target
from mercalith.session import get_session

__all__ = ["Violations", "build_target", "check", "get_session"]
