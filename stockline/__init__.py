"""Inventory, demand and replenishment analytics on Spark."""
