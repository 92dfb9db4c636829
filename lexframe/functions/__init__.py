"""Column-level building blocks: lexical patterns, token classes, literal values."""
