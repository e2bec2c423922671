"""Where bytes, lines and attribute records come from, and where they are kept."""
