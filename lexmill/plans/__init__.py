"""The operators wired to the test tables, each with the SQL that checks it."""
