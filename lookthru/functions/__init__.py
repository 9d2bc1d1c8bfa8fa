"""Column expressions. All stay in the JVM; none is a Python UDF."""
