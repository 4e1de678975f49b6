"""bindery: many-site web-page corpora to book-shaped tables, as Spark jobs."""
