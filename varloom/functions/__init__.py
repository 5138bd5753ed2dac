"""Column functions: distributions, losses and log-normal laws."""
