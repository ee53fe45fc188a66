"""DataFrame -> DataFrame operators; every one is set-oriented over all recordings."""
