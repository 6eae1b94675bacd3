"""Price-for-specification analytics as Spark DataFrame jobs."""

from specval.plans.cost_spec import cs_ratio, rank_by_cs  # noqa: F401
from specval.operators.features import prepare_features  # noqa: F401
