"""Column expressions: plain ``Column -> Column`` helpers, all inside codegen."""
