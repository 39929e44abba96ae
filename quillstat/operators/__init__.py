"""DataFrame -> DataFrame operators, keyed by ``post_id``."""
