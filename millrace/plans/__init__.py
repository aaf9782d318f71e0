"""Query understanding: what to retrieve, from where, for which wording."""
