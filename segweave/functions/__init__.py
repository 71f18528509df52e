"""Column functions: native expressions, so that they stay in generated code."""
