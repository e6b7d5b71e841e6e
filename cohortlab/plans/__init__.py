"""Named query catalog. Importing this package registers every query."""
from cohortlab.plans import q_etl, q_metrics, q_text, q_models  # noqa: F401
from cohortlab.plans.registry import REGISTRY  # noqa: F401
