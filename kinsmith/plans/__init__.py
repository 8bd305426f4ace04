"""The stages of a linkage run and their order; queries over the driver's tables."""
