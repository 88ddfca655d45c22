"""Compilers from definitions (queries, models, measures, visuals) to lazy Spark plans."""
