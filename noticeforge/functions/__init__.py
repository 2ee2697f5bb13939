"""Column functions and the few Arrow functions beside them."""
