"""kestrel — point-in-time features, plan transforms, Spark ML scoring,
schema profiling, run history, readiness scorecard and a hash-chained audit
trail, as DataFrame operators on Spark.

Packages: ``sources`` (scans, catalog, sinks), ``functions`` (column
expressions), ``operators`` (the data operators), ``plans`` (transform plans
and the registered queries), ``streaming`` (Structured Streaming jobs).
"""

__version__ = "0.1.0"
