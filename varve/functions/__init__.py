"""NumPy kernels of the actions, by pack."""
