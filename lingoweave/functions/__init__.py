"""functions of lingoweave."""
