"""A PySpark-native engine for maximum-likelihood phylogenetic placement."""
