"""Named queries bound to the test tables, with the SQL they are checked against."""
