"""Column-level building blocks: vectors, calibrated probabilities, text and boxes."""
