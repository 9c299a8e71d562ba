"""Column-level helpers shared by the operators (all JVM-side expressions)."""

from ballot.functions.exprs import clean_score, idiv, safe_ratio
from ballot.functions.small import MAX_BROADCAST_ROWS, bounded_broadcast, partitions_for, scalar_count

__all__ = [
    "MAX_BROADCAST_ROWS",
    "bounded_broadcast",
    "clean_score",
    "idiv",
    "partitions_for",
    "safe_ratio",
    "scalar_count",
]
