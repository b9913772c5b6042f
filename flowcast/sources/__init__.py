"""Sources and sinks: the driver tables, wide CSV traffic/weather files,
training-history CSVs, summary sinks and the fixtures derived from the tables."""
