"""Column functions: bases, genomes, k-mers and likelihoods."""
