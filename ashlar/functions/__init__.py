"""Functions over columns that Spark lacks."""
