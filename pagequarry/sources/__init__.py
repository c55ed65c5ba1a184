"""Where database files come from and where debug text goes."""
