"""Query plans over the star schema and the document tables."""
