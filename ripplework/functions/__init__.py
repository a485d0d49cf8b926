"""Column functions. Everything here stays inside the JVM."""
