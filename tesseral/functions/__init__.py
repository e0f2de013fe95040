"""Column functions: everything here builds Catalyst expressions."""
