"""The queries of the engine and the SQL that gives the same rows."""
