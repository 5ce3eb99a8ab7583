"""Sources and sinks: directory trees, tables and archives."""
