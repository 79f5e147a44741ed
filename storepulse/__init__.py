"""storepulse: retail analytics operators expressed as lazy Spark plans.

Every operator takes a mapping of retail DataFrames (see
``storepulse.sources.retail`` for the canonical schema) plus explicit
parameters, and returns an unevaluated DataFrame.  Nothing is collected to
the driver; the wall clock is replaced by an explicit ``as_of`` timestamp.
"""

__all__ = ["session", "sources", "functions", "operators", "plans", "streaming"]
