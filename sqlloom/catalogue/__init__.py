"""Read and write statements over the test tables, one block per operator."""
