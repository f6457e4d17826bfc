"""Views over the test tables and the query catalogue with its SQL twins."""
