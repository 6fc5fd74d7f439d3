"""The registered queries: skerry's operators over the test tables, each with its SQL twin."""
