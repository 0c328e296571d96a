"""Bill-of-materials analytics on Spark: sources, operators, plans and streams."""
