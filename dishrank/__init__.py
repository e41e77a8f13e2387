"""Item ratings from free text, as Spark DataFrame jobs.

Packages: ``functions`` (column functions), ``sources`` (readers and sinks),
``operators`` (DataFrame to DataFrame steps), ``plans`` (user-level jobs),
``streaming`` (Structured Streaming jobs), ``catalog`` (checkable queries over
the test tables with their SQL oracles).
"""
