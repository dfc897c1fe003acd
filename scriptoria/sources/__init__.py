"""Sources, sinks and store management."""
