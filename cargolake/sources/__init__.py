"""Reading feeds and writing tables."""
