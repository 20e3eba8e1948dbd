"""Structured Streaming forms of the stateful and continuous operators, with their batch twins."""
