"""The driver's tables in panel shape, the registered queries and their SQL partners."""
