"""Column builders: every function takes and returns Spark Columns and stays inside the JVM."""
