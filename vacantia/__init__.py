"""Listing-intelligence analytics on Spark."""
