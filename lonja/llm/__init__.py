"""Operators on texts and names. Nothing outside this subpackage imports it."""
