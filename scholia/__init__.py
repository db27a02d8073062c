"""A PySpark engine that turns study material and learner activity into queryable tables."""
