"""Readers that give documents, and the model they follow."""
