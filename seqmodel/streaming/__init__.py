"""The same scoring on streams."""
