"""Where rows come from: the commercial world derived from warehouse tables, and seeded worlds."""
