"""Sources, sinks and the shared folder."""
