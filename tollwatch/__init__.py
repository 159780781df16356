"""Messaging-fraud analytics on Spark: blocks, traffic, accounts, lists, tickets."""
