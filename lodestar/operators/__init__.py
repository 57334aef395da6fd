"""Relational operators over items, batches, pairs and neighbours."""
