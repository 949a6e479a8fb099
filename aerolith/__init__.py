"""aerolith: Spark-native operators for environmental sensor time series.

Every operator is a plain ``DataFrame -> DataFrame`` (or ``Column``) function.
Clocks, thresholds, keys and tie-breaks are arguments, so each one can be
checked against an independent SQL oracle and composed into batch or
Structured Streaming jobs.
"""

from aerolith.session import build_session, checkpoint_root

__all__ = ["build_session", "checkpoint_root"]
__version__ = "0.1.0"
