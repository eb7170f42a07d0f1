"""Sources and sinks: source trees, contract documents, snapshots, reports."""
