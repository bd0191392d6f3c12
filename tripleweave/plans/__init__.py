"""plans of tripleweave."""
