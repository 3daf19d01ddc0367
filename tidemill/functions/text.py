"""Text extraction."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the badge pattern whose first capture is the version.
VERSION_PATTERN = r"img\.shields\.io/badge/version-([^-]+)-"


def version_of(text: Column) -> Column:
    """Version of the first version badge in the text; ``unknown`` for null, no badge or an empty capture.

    The capture ends at the first ``-``, so a badge of ``0.1--rc1`` gives ``0.1``.
    """
    found = F.regexp_extract(text, VERSION_PATTERN, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))
