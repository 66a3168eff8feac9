"""Column expressions: they stay inside the JVM and never shuffle."""
