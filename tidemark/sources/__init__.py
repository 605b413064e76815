"""Where rows come from: versioned tables, pipe-separated files, SQL scripts."""
