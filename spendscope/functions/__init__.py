"""Column-level building blocks (all JVM-side expressions except the prompt-hash helper)."""
