"""Sources and sinks: CSV, workbooks and stored tables."""
