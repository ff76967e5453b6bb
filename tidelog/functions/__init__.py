"""Column functions: everything here is a built-in expression, so it stays in generated code."""
