"""Input tables: schemas, readers, and the mapping from the bundled test tables."""
