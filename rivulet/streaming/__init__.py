"""Windows over streams and batches, and running scripts as streaming queries."""
