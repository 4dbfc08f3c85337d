"""plans of lingoweave."""
