"""Plan-level helpers: sessions, shipping of code, table access."""
