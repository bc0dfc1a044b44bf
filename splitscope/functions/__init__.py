"""Column-expression helpers (JVM-side) and the vectorised p-value tails."""
