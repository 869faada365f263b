"""Column expressions: everything here maps Columns to Columns and runs inside the JVM."""
