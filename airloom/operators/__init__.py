"""DataFrame -> DataFrame operators; every one takes its key columns and stays lazy."""
