"""The queries of the driver contract, with the SQL that must give the same rows."""
