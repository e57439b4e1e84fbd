"""Writers of track files, tags and texts."""
