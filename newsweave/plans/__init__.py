"""Jobs from stored tables to stored results."""
