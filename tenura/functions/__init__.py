"""Column functions and scalar statistics."""
