"""Plans: which chains each parent gets."""
