"""Import every catalog module so that its queries register."""

from vigil.plans import catalog_business  # noqa: F401
from vigil.plans import catalog_io  # noqa: F401
from vigil.plans import catalog_profile  # noqa: F401
from vigil.plans import catalog_quality  # noqa: F401
from vigil.plans import catalog_relational  # noqa: F401
from vigil.plans import catalog_stats  # noqa: F401
from vigil.plans import catalog_features  # noqa: F401
from vigil.plans import catalog_eval  # noqa: F401
from vigil.plans import catalog_monitor  # noqa: F401
from vigil.plans import catalog_fairness  # noqa: F401
from vigil.plans import catalog_robustness  # noqa: F401
from vigil.plans import catalog_streaming  # noqa: F401
