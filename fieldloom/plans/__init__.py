"""Plans: the driver's queries and the recipe graph."""
