"""DataFrame -> DataFrame operators. No collects, no loops over rows."""
