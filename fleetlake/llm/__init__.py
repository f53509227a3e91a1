"""Operators for training data: text and embedding jobs that nothing else in the library imports."""
