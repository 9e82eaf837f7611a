"""Training-data operators: tokenising, chat formatting, near-duplicates, toxicity, mixing, vector search, WARC and URL work.

Each module holds one operator with a general interface and the thin ``opN_*`` query that applies it to a whole table.
``registry`` collects the queries and their SQL.  Nothing outside this subpackage imports it.
"""
