"""Sources and sinks: driver tables, fixture adapter, catalog readers, writers."""
