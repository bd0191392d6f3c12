"""Knowledge-graph integration on Spark: tables, text and triples in, linked graphs out."""
