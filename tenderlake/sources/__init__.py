"""Tables, page caches and sinks."""
