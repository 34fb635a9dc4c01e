"""Column expressions: every one stays JVM-side, without a UDF."""
