"""Named queries over the driver's tables, each beside its DuckDB SQL."""

from cadenza.plans import catalogue, curation, recommendation, streams  # noqa: F401
from cadenza.plans.registry import QUERIES, SQL  # noqa: F401
