"""Where rows come from: files, document kinds, page ranges, replies of a model, and tables derived from plain ones."""
