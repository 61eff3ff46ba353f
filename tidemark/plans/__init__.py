"""Plans: what would be done, and why the rest would not."""
