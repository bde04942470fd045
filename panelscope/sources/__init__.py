"""Table scans, sinks and the canonical domain views over the test tables."""
