"""numpy-only kernels; nothing here imports Spark."""
