"""Writers: delimited text and workbooks."""
