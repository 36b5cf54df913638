"""Column functions: complex numbers, kernels, draws and names."""
