"""Column functions over document text, boxes and check digits."""
