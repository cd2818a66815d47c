"""Reports, sinks, logs, pictures, and frames that cut lineage."""
