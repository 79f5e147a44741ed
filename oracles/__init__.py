"""Independent DuckDB SQL oracles for every registered query.

section 2), not from the Spark code.  ``RETAIL`` re-derives the retail tables
from the driver's raw views with plain SQL; every oracle starts with it.
"""

from oracles.retail_sql import RETAIL  # noqa: F401
from oracles.queries_sql import ORACLES  # noqa: F401
