"""A PySpark engine for document graphs, preference data and training-data preparation."""
