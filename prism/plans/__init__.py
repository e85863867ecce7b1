"""Registered queries over the driver tables (imported for their side effect)."""

from prism.plans import q_profile  # noqa: F401
from prism.plans import q_stats  # noqa: F401
from prism.plans import q_workspace  # noqa: F401
from prism.plans import q_functions  # noqa: F401
from prism.plans import q_charts  # noqa: F401
from prism.plans import q_model  # noqa: F401
from prism.plans import q_io  # noqa: F401
