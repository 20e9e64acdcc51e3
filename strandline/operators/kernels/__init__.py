"""Alignment and consensus kernels: the only row-at-a-time code, run in Arrow batches or per group."""
