"""Where points, matrices and requests come from."""
