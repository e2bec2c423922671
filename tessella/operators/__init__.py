"""Query operators over flat, keyed, attributed and sharded text."""
