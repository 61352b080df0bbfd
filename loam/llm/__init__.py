"""Training-data operators. Nothing else in loam imports this subpackage."""
