"""Sources: landed files in, documents out. Network fetching is not part of the engine; fetched pages, API
answers and form posts are read from files with fixed schemas."""
