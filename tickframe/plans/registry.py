"""All registered queries."""

from . import cleaning, core, distributions, events, intervals, matches, scalars, spatial, streams, trajectories  # noqa: F401
from .domain import ORACLES, QUERIES  # noqa: F401
