"""Tables of the log store: the write-ahead table, blocks of records and their manifest."""
