"""Part of tallyspark; see README.md."""
