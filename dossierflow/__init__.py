"""Document-collection analytics on Spark: inventory, pages, windows, pieces, search and upkeep."""
