"""Column functions and numpy kernels. Kernels take and give bytes, and have exact inverses."""
