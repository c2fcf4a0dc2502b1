"""Writers: logs that only grow, and tables that are replaced as a whole."""
