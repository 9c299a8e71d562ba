"""ballot: fuse the ranked lists of many recommenders into one stable pick per user.

Every operator takes and returns Spark DataFrames.  Nothing is collected to the
driver except scalar row counts used to decide whether a small side may be
broadcast, and the per-step decision of the admission gate (O28), which reads
one small row per candidate.
"""

from ballot import schema  # noqa: F401

__all__ = ["schema"]
