"""Training-data operators: ten corpus-scale jobs written as Spark DataFrames.

Nothing outside this folder imports it. Each module holds one operator with a
general interface; ``queries`` derives the registered result tables from them.
"""
