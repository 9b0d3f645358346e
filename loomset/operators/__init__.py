"""DataFrame operators. Column names and parameters are arguments."""
