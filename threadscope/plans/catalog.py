"""Import every catalogue module so that ``registry.QUERIES`` / ``ORACLES``
are complete."""

from . import (q_catalog, q_comments, q_eval, q_io, q_models, q_rules,  # noqa: F401
               q_steps, q_summary)
from .registry import ORACLES, QUERIES  # noqa: F401
