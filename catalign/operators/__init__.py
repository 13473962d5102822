"""DataFrame-to-DataFrame operators, one module per area of the catalogue work."""
