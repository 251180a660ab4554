"""Column functions: they take and return Spark columns and stay inside code generation."""
