"""clausewise: contract-clause risk review and hybrid legal retrieval as Spark jobs."""
