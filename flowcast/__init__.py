"""flowcast: Spark-native time-series preparation, statistics and forecast evaluation.

Every operator is a function ``DataFrame -> DataFrame`` built on the public
DataFrame / SQL / ML APIs. Ordered operators (lags, rolling means, fills,
sequences) run on bounded chunks of a distributed row index instead of a
single-task global window; see :mod:`flowcast.operators.ordered`.
"""

__version__ = "0.1.0"
