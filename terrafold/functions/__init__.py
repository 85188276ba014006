"""Column builders: scalars, dates, colours, sets and geometry."""
