"""Column functions: Column in, Column out, inside the JVM."""
