"""Column expressions: pure functions from Column to Column, evaluated inside the JVM."""
