"""Column builders: keys, dates, codes, numbers, vectors and kernels."""
