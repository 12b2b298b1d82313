"""Table, file and provider sources; export sinks."""
