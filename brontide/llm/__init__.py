"""Training-data operators over document, page and conversation tables.

Each module holds one operator with a general DataFrame interface; ``registry``
holds the thin queries.  Nothing outside this subpackage imports it.
"""
