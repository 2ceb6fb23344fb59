"""Training-data operators: each module is one operator on DataFrames.

Nothing else in the library imports this subpackage.
"""
