"""sources of tripleweave."""
