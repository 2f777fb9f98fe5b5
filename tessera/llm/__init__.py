"""Training-data operators (line, substring, exact and near dedup, scoring, mixing, scans).

Nothing else in the library imports this subpackage; ``__spark_entry__`` registers its queries
only when it is present.
"""
