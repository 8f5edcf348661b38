"""Training-data operators: tokens, de-duplication, packing, scoring, screening.

Each module holds one operator with a general interface (DataFrames in, DataFrames out).
``queries`` binds them to the driver tables. Nothing else in the library imports this package.
"""
