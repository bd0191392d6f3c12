"""operators of tripleweave."""
