"""Tree ensembles that are learned by passes over a stored table of bins."""
