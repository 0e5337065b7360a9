"""Column-level functions (hash, quality, text) evaluated inside the JVM."""
