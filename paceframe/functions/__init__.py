"""Column-level functions. Everything here is a JVM expression; nothing runs in Python per row."""
