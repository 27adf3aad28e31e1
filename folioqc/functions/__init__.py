"""Column functions: text, geometry, fuzzy similarity, small rasters."""
