"""Plans: end-to-end compositions of operators over the driver's tables,
registered by name with their SQL oracles (see ``catalog``)."""
