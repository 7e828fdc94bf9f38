"""Tarmac: data quality, feature engineering and imbalanced classification on Spark.

Every operator takes a DataFrame and returns a DataFrame, so a flow is a chain of
``df.transform(op)`` calls that Catalyst sees as one plan.
"""
