"""All registered queries."""

from __future__ import annotations

from plumbline.plans import audit, checks, cleaning, composites, learning, pieces, spatial, stores, studies, temporal  # noqa: F401 - they register
from plumbline.plans.tables import ORACLES, QUERIES  # noqa: F401
from plumbline.plans.temporal import skill_by_unit  # noqa: F401
