"""DataFrame -> DataFrame operators; every function only declares a plan."""
