"""All queries and their SQL by name; importing the plans registers them."""

from .plans import dedup, evaluation, labels, logs, records, retrieval, sampling, streams, texts  # noqa: F401
from .plans.registry import QUERIES, SQL  # noqa: F401
