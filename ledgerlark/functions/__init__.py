"""Functions of the retail and evidence engine."""
