"""Plans made of several operators, and the queries that the driver runs."""
