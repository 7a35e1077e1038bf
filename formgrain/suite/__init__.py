"""Queries of the driver contract, with the documents they are run on."""
