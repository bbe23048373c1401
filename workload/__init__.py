"""The driver's tables seen as feedback tables, the registered queries and their SQL."""
