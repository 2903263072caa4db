"""Sources: directory trees, text extraction, the cache of extracted texts."""
