"""changewatch: change tracking for scraped listings, as PySpark DataFrame operators."""
