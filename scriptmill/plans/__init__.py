"""Plans: the end products, composed of operators."""
