"""All registered queries. Importing this package fills the registry."""

from tonnage.catalog import views  # noqa: F401  (defines the CTEs first)
from tonnage.catalog import star_queries  # noqa: F401
from tonnage.catalog import relational_queries  # noqa: F401
from tonnage.catalog import quality_queries  # noqa: F401
from tonnage.catalog import model_queries  # noqa: F401
from tonnage.catalog import scenario_queries  # noqa: F401
from tonnage.catalog.base import ENTRIES, run

__all__ = ["ENTRIES", "run"]
