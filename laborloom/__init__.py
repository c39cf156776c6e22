"""Small-business labor indicators as composable Spark DataFrame operators.

Every operator takes DataFrames plus plain parameters and returns a DataFrame;
no operator reads the wall clock (``as_of`` is always a parameter). Results are
lazy plans. Only the weekly table stages two shared aggregates while it is
built, and only where the cluster names a folder for that; the ``require_*``
checks run the small aggregate they judge.
"""
