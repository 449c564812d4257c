"""Named queries over the test tables, with the SQL that gives the same rows."""
