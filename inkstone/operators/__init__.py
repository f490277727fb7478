"""Operators that built-in functions can't express."""
