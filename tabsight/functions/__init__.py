"""Column-expression builders shared by the operators (all JVM-side, no Python UDFs)."""
