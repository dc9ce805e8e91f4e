"""Relations from files and tables."""
