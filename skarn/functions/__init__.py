"""Column functions: text, paths, vectors, scores.  All are JVM-side expressions unless they say otherwise."""
