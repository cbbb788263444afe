"""fieldspark: spatial, gridded and matrix-shaped tables as Spark jobs."""
