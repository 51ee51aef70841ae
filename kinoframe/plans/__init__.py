"""Tables of traces and blocks, derived from the given ones."""
