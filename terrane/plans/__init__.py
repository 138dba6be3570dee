"""Multi-step jobs: kernels, solvers, random walks, paths, regression, density."""
