"""Column expressions: everything here stays inside whole-stage codegen."""
