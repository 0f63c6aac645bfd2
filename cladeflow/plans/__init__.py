"""Plans: trees, the tables they become, and alignments derived from the star schema."""
