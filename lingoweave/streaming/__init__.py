"""streaming of lingoweave."""
