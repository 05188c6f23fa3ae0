"""Column functions: text, time and array expressions that stay in the JVM."""
