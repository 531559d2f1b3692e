"""Plans: context paths, the pivot, SQL over the relations, and the cost schedule."""
