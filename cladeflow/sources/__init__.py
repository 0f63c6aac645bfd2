"""Readers and writers: FASTA, PHYLIP, Newick, model files and jplace."""
