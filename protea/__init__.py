"""protea: Spark-native annotation transfer and multi-label scoring.

Every public operator is a DataFrame -> DataFrame function. Heavy work
(joins, aggregations, windows, melts, splits, metrics) runs as Catalyst
plans; Python only runs inside Arrow-batched functions where a model has
to be evaluated (embedding, tree/MLP training passes, scoring).
"""

__version__ = "0.1.0"
