"""sources of lingoweave."""
