"""Where rows come from: source trees, tables and the ignore list."""
