"""Training-data operators: an optional subpackage that nothing else in the library imports."""
