"""Query registry and DuckDB oracle text.

Importing this package registers every query module.
"""

from framewise.plans.registry import REGISTRY, QuerySpec, finalize, oracle_text  # noqa: F401
from framewise.plans import q_signals  # noqa: F401,E402
from framewise.plans import q_supply  # noqa: F401,E402
from framewise.plans import q_recommend  # noqa: F401,E402
from framewise.plans import q_kpis  # noqa: F401,E402
from framewise.plans import q_similarity  # noqa: F401,E402
from framewise.plans import q_features  # noqa: F401,E402
from framewise.plans import q_diagnostics  # noqa: F401,E402
from framewise.plans import q_model  # noqa: F401,E402
from framewise.plans import q_sources  # noqa: F401,E402
