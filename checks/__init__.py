"""Every job as a query over the test tables, with the SQL it must agree with."""
