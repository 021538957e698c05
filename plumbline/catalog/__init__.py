"""Named queries over the given tables."""

from plumbline.catalog import audit, claims, files, labels, memory, ratios, runs, search, streaming, windows  # noqa: F401
from plumbline.catalog.base import ORACLES, QUERIES  # noqa: F401
