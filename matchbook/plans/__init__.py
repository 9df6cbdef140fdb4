"""Named compositions of operators, each registered with its defining SQL."""
