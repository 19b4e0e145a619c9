"""Spark-native analytics for evidence-grounded question answering.

The package is layered: ``functions`` holds Column expressions, ``operators``
holds DataFrame-to-DataFrame transforms, ``sources`` reads and writes tables,
``streaming`` runs the row-wise operators over streams, and ``plans`` binds the
operators to concrete tables as named queries with SQL twins.
"""

__version__ = "0.1.0"
