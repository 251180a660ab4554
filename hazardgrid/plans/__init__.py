"""Query catalogue: importing this package fills ``registry.QUERIES`` and ``CHECK_SQL``."""
