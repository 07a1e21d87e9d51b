"""Column functions: languages, paths, lines, call sites and text folding."""
