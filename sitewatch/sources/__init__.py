"""Where the six domains come from: transport files, tables, the driver's tables."""
