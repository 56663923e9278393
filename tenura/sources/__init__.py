"""Reading nested records and tables, and writing results."""
