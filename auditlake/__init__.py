"""Analytics over crawled web pages: signals, audit rules, findings and reports as DataFrames."""
