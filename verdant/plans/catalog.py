"""Imports every plan module so that all queries are registered.

Model-training and stream-replay queries are registered last: they run longest and need
the most memory, so everything else has run by the time they start.
"""

from verdant.plans import farm, files, metrics, profile, sensors  # noqa: F401
from verdant.plans import models, streams  # noqa: F401
