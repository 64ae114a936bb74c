"""tillsight: retail sales analytics as Spark DataFrame / MLlib operators.

Packages: ``sources`` (tables, files), ``functions`` (column expressions),
``operators`` (cleaning, filters, aggregates, windows, joins, models, rules),
``plans`` (pipelines and the registered query catalog), ``streaming``
(incremental versions of the chart aggregates).
"""

__version__ = "0.1.0"
