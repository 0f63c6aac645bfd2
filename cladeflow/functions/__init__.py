"""Scalar building blocks: alphabets, substitution models and tree text."""
