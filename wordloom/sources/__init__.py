"""Sources and sinks: corpus tables, stop lists, query words, model files."""
