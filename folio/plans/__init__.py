"""Whole commands, composed of operators, sources and sinks."""
