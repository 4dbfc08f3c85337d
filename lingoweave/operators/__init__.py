"""operators of lingoweave."""
