"""Analytics over online discussions on Spark: sources, operators, plans and streams."""
