"""Training-data operators: thirteen operators on documents and vectors that nothing else in the library imports."""
