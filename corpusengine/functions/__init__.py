"""Column functions: text, arrays, vectors, Arrow functions, SQL registration."""
