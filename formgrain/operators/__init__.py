"""Table operators over documents and their lines."""
