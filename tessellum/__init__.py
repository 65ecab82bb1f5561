"""tessellum: document and asset evidence analytics as plain PySpark DataFrame transformations."""
