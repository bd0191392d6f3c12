"""streaming of tripleweave."""
