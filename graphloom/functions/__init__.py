"""Scalar functions of the engine as Column expressions; everything stays in the JVM."""
