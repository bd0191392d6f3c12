"""functions of tripleweave."""
