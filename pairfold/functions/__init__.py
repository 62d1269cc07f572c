"""Scalar functions, predicates and geometry as Columns; everything stays in the JVM."""
