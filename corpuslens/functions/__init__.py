"""Column functions: text, paths, code structure, review text and limits."""
