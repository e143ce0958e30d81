"""Relations of the engine over the driver's tables, and the named queries with their SQL."""
