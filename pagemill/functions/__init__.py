"""Column expressions and the few Arrow functions that built-ins cannot express."""
