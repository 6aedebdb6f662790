"""Sources and sinks: files, raw text and JSON payloads to and from the canonical tables."""
