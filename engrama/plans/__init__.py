"""Operators put together: the recall plan and a store's verbs."""
