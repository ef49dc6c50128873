"""Sources and sinks: lake catalog and reads, SQL over a table, JDBC profiles, keyed caches."""
