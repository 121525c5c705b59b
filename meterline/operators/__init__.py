"""``DataFrame [, params] -> DataFrame`` operators."""
