"""Column functions: text primitives with exact, documented semantics."""
