"""Operators on alignments, trees, likelihoods and placements, as DataFrame plans."""
